"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern, and each piece is encoded by itself: its bytes are the first tokens, and the
neighbouring pair whose joined bytes have the lowest rank is merged, the leftmost first, until no pair is in the vocabulary.

The pieces of a batch are made unique and put by length into padded numpy matrices.  In every round each row of a matrix
merges its leftmost pair of minimum rank; ranks of pairs come from an open-addressing hash table, and only the two pairs
beside a merge are looked up again.  The merged position is squeezed out of the matrix, and rows without a pair leave it.
Pieces of more than ``LONGEST_ROW`` bytes would need as many rounds as they have bytes; they take a heap with the same order
of merges instead.

Null texts count as empty and have no ids.  Rows and their other columns stay; equal rows give equal results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import regex
from pyspark.sql import DataFrame

from ringside.llm.common import kept, with_fields

BUCKETS = (4, 8, 16, 32, 64, 128, 256, 512)
LONGEST_ROW = BUCKETS[-1]
#: A worker forgets its known pieces beyond this number, which bounds its memory.
MEMO = 200_000
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class PairTable:
    """Hash table from a pair of token ids to the rank of the joined token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(rank), 1) * 2 + 1))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        key, slot = self._key(left, right)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several for one slot, the last one stays
            placed = self.keys[slot] == key
            self.rank[slot[placed]] = rank[placed]
            key, rank, slot = key[~placed], rank[~placed], (slot[~placed] + 1) & self.mask

    def _key(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return key, (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE for a pair that isn't a token or has a negative id."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key, slot = self._key(left.ravel()[at], right.ravel()[at])
        flat = out.reshape(-1)
        while len(at):
            held = self.keys[slot]
            hit = held == key
            flat[at[hit]] = self.rank[slot[hit]]
            go = ~hit & (held != -1)
            at, key, slot = at[go], key[go], (slot[go] + 1) & self.mask
        return out


class Codec:
    """Encoder and decoder for one file of ranks and one pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.split = regex.compile(pattern).findall
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        vocab = {base64.b64decode(t): int(r) for t, r in pairs}
        self.vocab = vocab
        size = max(vocab.values()) + 1
        self.first = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in vocab.items():
            for i in range(1, len(token)):
                a, b = vocab.get(token[:i]), vocab.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.table = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        tokens: list[bytes] = [b""] * size
        for token, r in vocab.items():
            tokens[r] = token
        self.tokens = tokens
        self.decimal = [str(i) for i in range(size)]
        self.memo: dict[str, bytes] = {}

    def encode_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of at most LONGEST_ROW bytes, as little-endian int32."""
        out: list[bytes] = [b""] * len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for width in BUCKETS:
            which = np.flatnonzero((length > low) & (length <= width))
            low = width
            if not len(which):
                continue
            own = length[which]
            fill = np.frombuffer(b"".join(pieces[i] for i in which), np.uint8)
            ids = np.full((len(which), width), -1, np.int32)
            ids[np.arange(width) < own[:, None]] = self.first[fill]
            self._merge(ids, which, out)
        return out

    def _merge(self, ids: np.ndarray, which: np.ndarray, out: list[bytes]) -> None:
        rank = self.table.look(ids[:, :-1], ids[:, 1:])
        while len(which):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(which), np.int64)
            low = rank[np.arange(len(which)), best] if rank.shape[1] else np.full(len(which), NONE)
            done = low == NONE
            if done.any():
                for i, row in zip(which[done].tolist(), ids[done], strict=True):
                    out[i] = row[row >= 0].tobytes()
                go = ~done
                ids, rank, which, best, low = ids[go], rank[go], which[go], best[go], low[go]
                if not len(which):
                    return
            n, width = ids.shape
            rows = np.arange(n)
            ids[rows, best] = low
            keep = np.ones((n, width), bool)
            keep[rows, best + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            rank = rank[keep[:, 1:]].reshape(n, width - 2)
            # The pair at best is gone; the pairs on both sides of the merged token are looked up anew.
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < width - 2))
                rank[ok, at[ok]] = self.table.look(ids[ok, at[ok]], ids[ok, at[ok] + 1])

    def encode_long(self, piece: bytes) -> bytes:
        """Ids of one long piece: a heap of (rank, position) over a linked list, in the same order of merges."""
        vocab, parts, n = self.vocab, [piece[i : i + 1] for i in range(len(piece))], len(piece)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := vocab.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], k = a + b, None, after[j]
            after[i] = k
            if k < n:
                before[k] = i
            for p, q in ((before[i], i), (i, k)):
                if p >= 0 and q < n and (r := vocab.get(parts[p] + parts[q])) is not None:
                    heapq.heappush(heap, (r, p, parts[p], parts[q]))
        return np.array([vocab[p] for p in parts if p is not None], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.split(t) if t else [] for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        fresh = list({p for pieces in split for p in pieces}.difference(memo))
        raw = [p.encode("utf-8", "surrogatepass") for p in fresh]
        short = [i for i, b in enumerate(raw) if len(b) <= LONGEST_ROW]
        for i, ids in zip(short, self.encode_rows([raw[i] for i in short]), strict=True):
            memo[fresh[i]] = ids
        for i, b in enumerate(raw):
            if len(b) > LONGEST_ROW:
                memo[fresh[i]] = self.encode_long(b)
        return [np.frombuffer(b"".join(map(memo.__getitem__, pieces)), np.int32) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def text(self, ids: np.ndarray) -> str:
        """The decimal ids joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids.tolist()))


def codec(ranks: bytes, pattern: str) -> Codec:
    return kept(("bpe", ranks, pattern), lambda: Codec(ranks, pattern))


def _shipped(df: DataFrame, ranks_path: str):
    """The file of ranks, about 1 MB whatever the input, read once by the driver and sent to each executor once."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the array<int> column ``out``: the ids of the whole text, without special tokens.

    Null and empty texts give an empty array.  A column named ``out`` is replaced.
    """
    ranks = _shipped(df, ranks_path)

    def make():
        own = codec(ranks.value, pattern)
        return lambda texts: {out: own.encode(texts)}

    return with_fields(df, text_col, f"`{out}` array<int>", make)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """``df`` with the binary column ``out``: the bytes of the ids.  Null and empty arrays give no bytes."""
    ranks = _shipped(df, ranks_path)

    def make():
        own = codec(ranks.value, pattern)
        return lambda rows: {out: [own.decode(np.asarray([] if r is None else r, np.int64)) for r in rows]}

    return with_fields(df, ids_col, f"`{out}` binary", make)


def digests(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256: each text is encoded, and the ids are decoded again.

    The ids themselves needn't leave the worker, so that nothing but the text is moved.
    """
    ranks = _shipped(df, ranks_path)

    def make():
        own = codec(ranks.value, pattern)

        def run(texts):
            ids = own.encode(texts)
            return {
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [hashlib.sha256(own.text(i).encode()).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(own.decode(i)).hexdigest() for i in ids],
            }

        return run

    return with_fields(df, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
