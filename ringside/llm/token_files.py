"""Token-id output: ids bit-packed at a fixed width, in blocks with offsets.

A token file is one binary value.  All numbers are little-endian.

    4 bytes   magic ``RTK1``
    u32       bits of an id: the fewest that hold the largest id of the vocabulary
    u32       documents
    u32       ids in a block
    u64       ids
    u64 each  ids of all documents before it in this file, for each document and once more at the end
    u64 each  byte offset of each block in the body, and the body's end
    body      blocks; in each, id k takes the bits k * width up to (k + 1) * width, lowest bit first; padded to whole bytes

Since the width is fixed, id number i stands in block i // ids-in-a-block at a known bit: any range is read without the rest.

``write`` range-partitions the documents by id, encodes each partition in ascending order and cuts it into files of bounded
size.  The files are rows of a Parquet table in the folder shared by all executors, written by Spark itself, so that they
are replaced whole when a task is run again.  ``read`` unpacks every file and gives each document its ids and its global start.
Only the number of ids of each partition goes to the driver.

Null texts count as empty: they have the end id only.  Documents with equal ids of documents stay separate, in the order of
their texts; a null document id comes first.  No other columns than the id and the text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.llm.common import give_back, kept, materialize, slices, small_batches

MAGIC = b"RTK1"
BLOCK = 4096
#: A file is closed when it holds so many ids; a longer document has a file of its own.
FILE_IDS = 2_000_000
#: A worker keeps so many words, and as many again that it knew before; those not seen since are forgotten.
MEMO = 600_000


def width_of(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """The ids at ``width`` bits each, lowest bit first, padded to whole bytes."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, width: int, n: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


def write_file(docs: list[np.ndarray], width: int, block: int = BLOCK) -> bytes:
    """One token file of the documents' ids."""
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} needs more than {width} bits")
    starts = np.zeros(len(docs) + 1, "<u8")
    starts[1:] = np.cumsum([len(d) for d in docs])
    blocks = [pack_bits(ids[i : i + block], width) for i in range(0, len(ids), block)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    offsets[1:] = np.cumsum([len(b) for b in blocks])
    head = MAGIC + np.array([width, len(docs), block], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    return b"".join([head, starts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Random access to one token file."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.width, self.n_docs, self.block = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
        self.n_ids = int(np.frombuffer(data, "<u8", 1, 16)[0])
        n_blocks = -(-self.n_ids // self.block)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, 24).astype(np.int64)
        at = 24 + 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.body = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids number low up to high, from the blocks that hold them."""
        if high <= low:
            return np.zeros(0, np.uint32)
        first, last = low // self.block, (high - 1) // self.block
        parts = [unpack_bits(self.body[self.offsets[b] : self.offsets[b + 1]], self.width, min(self.block, self.n_ids - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[low - first * self.block : high - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


#: ASCII punctuation without the apostrophe, which starts suffixes such as 's, and without the signs that may modify a letter.
_SIGNS = r"!-&(-/:-@\[-\]{-}"
#: Where the vocabulary's splitter always cuts: between a letter or digit and such a sign.
_CUTS = re.compile(rf"(?<=[^\W_])(?=[{_SIGNS}])|(?<=[{_SIGNS}])(?=[^\W_])")
_ENDS = frozenset(".,;:!?%&#$*|()\"")  # of them, those that often end a word
#: So many pieces are encoded as one text.
_JOINED = 256


class WordEncoder:
    """Encodes texts with the tokenizers library.

    The vocabulary's normalizer and splitter drop white space and never join across it, nor between a letter and a sign, so
    the library encodes each distinct word (a run without ASCII white space), or each distinct piece of one, once, and a
    text is the joined ids of its words.  Pieces of letters only are one split each and are encoded many at a time, joined by
    spaces: the ids that end a split tell them apart.  Texts with an added token's string, which the library cuts out before
    all else, or with U+0130, whose lower case is two characters, are encoded whole.
    """

    def __init__(self, config: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = re.compile("|".join(["\u0130", *added])).search
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.former: dict[bytes, bytes] = {}

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _letters(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of letters only."""
        out = []
        for low in range(0, len(pieces), _JOINED):
            part = pieces[low : low + _JOINED]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            end = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(end) != len(part):  # a letter whose lower case is a letter and a mark
                out += self._each(part)
                continue
            raw, at = ids.tobytes(), 0
            for stop in end.tolist():
                out.append(raw[at:stop])
                at = stop
        return out

    def _learn(self, fresh: set[bytes]) -> None:
        """Put the ids of new words into the memo."""
        memo, split = self.memo, {}
        for raw in fresh:
            w = raw.decode("utf-8", "surrogatepass")
            if w.isalpha():
                split[raw] = (w,)
            elif w[-1] in _ENDS and w[:-1].isalpha():
                split[raw] = (w[:-1], w[-1])
            else:
                split[raw] = _CUTS.split(w)
        pieces = {p for ps in split.values() for p in ps}
        known = {p: ids for p in pieces if (ids := memo.get(p.encode("utf-8", "surrogatepass"))) is not None}
        letters = [p for p in pieces if p not in known and p.isalpha()]
        known.update(zip(letters, self._letters(letters), strict=True))
        rest = [p for p in pieces if p not in known]
        for low in range(0, len(rest), 5000):
            part = rest[low : low + 5000]
            known.update(zip(part, self._each(part), strict=True))
        for raw, ps in split.items():
            memo[raw] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        if len(self.memo) > MEMO:
            self.former, self.memo = self.memo, {}
        memo, end = self.memo, np.array([end_id], "<u4").tobytes()
        whole = {i: t for i, t in enumerate(texts) if t and self.apart(t)}
        # Lower case and splits by ASCII only, which the library's own steps don't undo; it does the rest.
        words = [t.encode("utf-8", "surrogatepass").lower().split() if t and i not in whole else [] for i, t in enumerate(texts)]
        flat = [w for ws in words for w in ws]
        found = list(map(memo.get, flat))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            fresh = {flat[i] for i in missing}
            memo.update((w, ids) for w in fresh if (ids := self.former.get(w)) is not None)
            self._learn(fresh.difference(memo))
            for i in missing:
                found[i] = memo[flat[i]]
        ids, at = [], 0
        for ws in words:
            ids.append(b"".join(found[at : at + len(ws)]))
            at += len(ws)
        for i, raw in zip(whole, self._each(list(whole.values())), strict=True):
            ids[i] = raw
        return [np.frombuffer(raw + end, "<u4") for raw in ids]


def word_encoder(config: str) -> WordEncoder:
    return kept(("words", config), lambda: WordEncoder(config))


#: Rows of one id go to ranges by so much of their texts, in whose order they are written.
RANGE_CHARS = 64

FILES = "shard int, seq int, doc_ids binary, nulls binary, first long, n_ids long, content binary"


def write(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs``; returns the table of files, one row per file.

    Columns: shard (a range of document ids), seq (the file's place in it), doc_ids and nulls (the documents' ids as int64, and
    which of them are null), first (ids of the shard before this file), n_ids and content (the file).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        config = f.read()
    from tokenizers import Tokenizer

    small_batches(docs.sparkSession)
    width = width_of(Tokenizer.from_str(config).get_vocab_size(with_added_tokens=True))
    shipped = docs.sparkSession.sparkContext.broadcast(config)  # the vocabulary, some MB whatever the input

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, seq, before = word_encoder(shipped.value), 0, 0
        keys: list = []
        held: list[np.ndarray] = []
        shard = size = 0

        def close():
            nonlocal seq, before, keys, held, size
            ids = np.array([0 if k is None else k for k in keys], "<i8")
            nulls = np.array([k is None for k in keys], np.uint8)
            row = (shard, seq, ids.tobytes(), nulls.tobytes(), before, size, write_file(held, width))
            seq, before, keys, held, size = seq + 1, before + size, [], [], 0
            return pd.DataFrame([row], columns=["shard", "seq", "doc_ids", "nulls", "first", "n_ids", "content"])

        for batch in batches:
            if not len(batch):
                continue
            shard = int(batch["shard"].iloc[0])
            ks = [None if k is None or k != k else int(k) for k in batch["doc_id"].astype(object).tolist()]
            at = 0
            for texts in slices(batch["text"].tolist()):
                for k, ids in zip(ks[at : at + len(texts)], encoder.encode(texts, end_id), strict=True):
                    if held and size + len(ids) > FILE_IDS:
                        yield close()
                    keys.append(k)
                    held.append(ids)
                    size += len(ids)
                at += len(texts)
        if held:
            yield close()
        give_back()

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, RANGE_CHARS).asc_nulls_first())  # null ids, and one of many rows, are divided too
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .withColumn("shard", F.spark_partition_id())
    )
    return materialize(ordered.mapInPandas(files, FILES), "token-files")


def shard_starts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(shard, base): ids of all shards before it.  One row per partition that wrote files."""
    sums = sorted((r["shard"], r["n"]) for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, rows = 0, []
    for shard, n in sums:
        rows.append((shard, base))
        base += n
    return spark.createDataFrame(rows, "shard int, base long")


READ = "doc_id long, start long, ids array<int>"


def read(files: DataFrame) -> DataFrame:
    """The documents of the token files: doc_id, start, ids."""
    return _read(files, READ, lambda ids: {"ids": [i.astype(np.int32) for i in ids]})


def read_digests(files: DataFrame) -> DataFrame:
    """Per document, from its file: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian u32)."""
    return _read(files, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: {"n_tokens": [len(i) for i in ids], "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]})


def _read(files: DataFrame, schema: str, columns) -> DataFrame:
    base = F.broadcast(shard_starts(files.sparkSession, files))  # a row per partition

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                f = TokenFile(row.content)
                ids, nulls = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.nulls, np.uint8).astype(bool)
                every = f.ids(0, f.n_ids)
                out = {"doc_id": pd.array(ids, "Int64"), "start": f.starts[:-1] + row.base + row.first}
                out["doc_id"][nulls] = pd.NA
                yield pd.DataFrame(out | columns([every[a:b] for a, b in zip(f.starts[:-1], f.starts[1:], strict=True)]))
        give_back()

    return files.join(base, "shard").select("doc_ids", "nulls", "first", "content", "base").mapInPandas(unpack, schema)
