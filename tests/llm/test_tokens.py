"""Binary records, byte-level BPE: against the libraries, and exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from telewatch.llm import bpe, queries, records
from telewatch.llm.chunks import cut

TEXTS = ["", None, " ", "  two  spaces \n\n and lines ", "a" * 3000, " " * 700, "don't we'll\t\tx", "<|endoftext|> here", "a <|endoftext|> b<|endoftext|>c, <|endoftext|>, <|endoftext| x", "word, word,*** word's, word'. (word). é!! 日本。,",
         "日本語 テキスト é á",
         "x\x1cy \x1c z\x85 \xa0q", "same text here", "same text here", "word " * 400, "1234 56-7"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.BYTE_BPE)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids + [0]


def test_checksums():
    assert int(records.crc32c(np.frombuffer(b"123456789", np.uint8), [9])[0]) == 0xE3069283
    lengths = np.array([0, 1, 3, 4, 5, 1023, 1024, 1025, 5000])
    data = np.random.default_rng(0).integers(0, 256, lengths.sum()).astype(np.uint8)
    ends = np.cumsum(lengths)
    assert [records._short(data[e - n:e].tobytes()) for e, n in zip(ends, lengths)] == records.crc32c(data, lengths).tolist()


def test_damage_is_found():
    blob, offsets = records.frame(np.frombuffer(b"\1\0\2\0\3\0", np.uint8), np.array([4, 2]))
    assert [x.tolist() for x in records.unframe(blob, offsets, np.array([2, 1]), "<u2")] == [[1, 2], [3]]
    for at in (0, 13):
        bad = bytearray(blob)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), offsets, np.array([2, 1]), "<u2")


def test_cut_never_splits_a_piece():
    pattern = __import__("regex").compile(P.PATTERN)
    for t in filter(None, TEXTS):
        first, *later = cut(t)
        assert first + "".join(" " + x for x in later) == t
        assert [p for c in [first, *(" " + x for x in later)] for p in pattern.findall(c)] == pattern.findall(t)


def test_few_words_are_kept_and_nothing_changes(library):
    encoder, _ = records.library_encoder(queries.BYTE_BPE)
    encoder.keep = 40
    rng = np.random.default_rng(3)
    for _ in range(30):
        words = [f"{'ab'[k % 2]}{'xyz' * (k % 7)}{['', ',', '***', '.', chr(39) + 's', chr(39)][k % 6]}" for k in rng.integers(0, 400, 60)]
        texts = [" ".join(words[:k]) for k in (0, 1, 30, 60)] + [" a  b ", "x " + " ".join(words[:3])]
        ids, counts = encoder.encode(texts)
        assert [x.tolist() + [0] for x in np.split(ids, np.cumsum(counts)[:-1])] == [library(t) for t in texts]
        assert len(encoder.known) <= 40 + 200  # what one batch asks for comes on top


def test_token_records(spark, documents, library):
    docs = documents(TEXTS).withColumnRenamed("lang", "ids").repartition(3)
    got = sorted(map(tuple, records.token_records(spark, docs, queries.BYTE_BPE).collect()))
    want, start = [], 0
    for i, t in enumerate(TEXTS):
        ids = library(t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_records_with_null_and_equal_ids(spark, library):
    rows = [(None, "b"), (3, "y"), (3, "x"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = records.write_records(docs, queries.BYTE_BPE)
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in sorted(records.read_records(manifest).collect(), key=lambda r: r.start)]
    assert got == [(None, library("b")), (1, library("")), (3, library("x")), (3, library("y"))]


def test_shuffled_reading(documents, library):
    manifest = records.write_records(documents(TEXTS), queries.BYTE_BPE)
    orders = []
    for seed in (1, 1, 2):
        rows = sorted(records.read_shuffled(manifest, seed).collect(), key=lambda r: r.place)
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: library(t) for i, t in enumerate(TEXTS)}
        orders.append([r.doc_id for r in rows])
    assert orders[0] == orders[1] != orders[2]


def test_empty_tables(spark, documents):
    empty = documents([])
    assert records.token_records(spark, empty, queries.BYTE_BPE).collect() == []
    assert bpe.digests(empty, queries.MULTI_BPE, P.PATTERN).collect() == []


@pytest.fixture(scope="module")
def multi():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(queries.MULTI_BPE), special_tokens={})


def test_bpe_equals_the_library(documents, multi):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(documents(TEXTS), queries.MULTI_BPE, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = multi.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_on_random_text(multi):
    rng = np.random.default_rng(3)
    merger = bpe.Merger(bpe.read_ranks(queries.MULTI_BPE), P.PATTERN)
    alphabet = list("abeint  \n\t'é1.$<日") + ["\x1c"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 80))) for _ in range(500)] + ["".join(rng.choice(list("abc"), 2000))]
    assert [np.frombuffer(x, "<u4").tolist() for x in merger.many(texts)] == [multi.encode_ordinary(t) for t in texts]


def test_bpe_keeps_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "hello", b"old", "k0")], "doc_id long, text string, ids binary, t string")
    row = bpe.decode(bpe.encode(df, queries.MULTI_BPE, P.PATTERN), queries.MULTI_BPE).first()
    assert (row.doc_id, row.text, row.t, bytes(row.decoded)) == (1, "hello", "k0", b"hello")
