"""Byte-level BPE and token files against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from ringside.llm import bpe, token_files

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def texts():
    r = random.Random(3)
    made = ["".join(r.choice("aé ß\n\t1!x日本👍 theİ.,-_.<|endoftext|>\x1c\xa0́") for _ in range(r.randint(0, 120))) for _ in range(300)]
    return [None, "", " ", "\n\n", "a", "Hello world, it's 2024!", "a" * 700, "ab" * 2000, "<|endoftext|>", "a <|startoftext|>b", "The cat. The cat."] + made * 2


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, "x", 5) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(docs):
    enc, want = tik(), texts()
    got = bpe.encode(docs, RANKS, P.PATTERN)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids"]  # a clashing column is replaced, others stay
    back = bpe.decode(got, RANKS, P.PATTERN).collect()
    assert len(back) == len(want)
    for r in back:
        assert list(r["ids"]) == enc.encode_ordinary(r["text"] or "")
        assert bytes(r["bytes"]) == (r["text"] or "").encode()


def test_bpe_digests(docs):
    enc = tik()
    for r in bpe.digests(docs.drop("ids", "n_tokens"), RANKS, P.PATTERN).collect():
        ids = enc.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_long_and_short_pieces_merge_alike():
    codec = bpe.codec(bpe.read_ranks(RANKS), P.PATTERN)
    r = random.Random(5)
    pieces = [bytes(r.choice(b"abcdeth \xc3\xa9") for _ in range(r.randint(1, 512))) for _ in range(400)]
    assert codec.encode_rows(pieces) == [codec.encode_long(p) for p in pieces]


def test_words_equal_library_beside_special_tokens():
    t, r = Tokenizer.from_file(WORDS), random.Random(11)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "hello", "It's", " ", "\n", "\u0130", "e\u0301", "\u212a", "12", "...", "\xa0", "\u3000", "\u65e5\u672c"]
    made = ["hello <|endoftext|> world", "a<|startoftext|>b"] + ["".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(3000)]
    with open(WORDS, encoding="utf-8") as f:
        got = token_files.WordEncoder(f.read()).encode(made, 1)
    assert [g.tolist() for g in got] == [e.ids + [1] for e in t.encode_batch(made, add_special_tokens=False)]
    assert got[0].tolist() == [3306, 49407, 1002, 1]


def test_bit_packing_round_trip():
    r = np.random.default_rng(1)
    for width in (1, 7, 13, 16, 17, 31, 32):
        docs = [r.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5, 4096, 9000, 3)]
        f = token_files.TokenFile(token_files.write_file(docs, width))
        assert all((f.document(k) == d).all() for k, d in enumerate(docs))
        assert (f.ids(4000, 5000) == np.concatenate(docs)[4000:5000]).all()
    with pytest.raises(ValueError):
        token_files.write_file([np.array([256], np.uint32)], 8)


def test_token_files_equal_library(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    t = Tokenizer.from_file(WORDS)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    files = token_files.write(docs, WORDS, end_id=1)
    got = {r["start"]: r for r in token_files.read(files).collect()}
    crcs = {r["start"]: r for r in token_files.read_digests(files).collect()}
    start = 0
    for k, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[start]["doc_id"], got[start]["ids"]) == (k, ids)
        assert (crcs[start]["doc_id"], crcs[start]["n_tokens"]) == (k, len(ids))
        assert crcs[start]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(rows)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0
    assert token_files.read_digests(token_files.write(none, WORDS, end_id=1)).count() == 0
