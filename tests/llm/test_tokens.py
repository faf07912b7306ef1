"""Token files and packing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from focalis.llm import bitpack, encoding, packing
from focalis.llm.shared import new_file

WORD, BYTE = ("word_bpe_49k.json", True, "0"), ("byte_bpe_50k.json", False, "\n")


@pytest.mark.parametrize("name,lower,separator", [WORD, BYTE])
def test_encoder_is_the_library(name, lower, separator, monkeypatch):
    r = random.Random(3)
    texts = [None, "", "a  b\n\nc", "don't I'll x's", "<|endoftext|> a <|startoftext|>x", "ΣΑΣ Σ", "a.\nb\r\nc", "  lead", "trail  ", "×a÷b"]
    texts += ["".join(r.choice("0aBéß '.,\n \t1×中́’<|>s") for _ in range(r.randint(0, 40))) for _ in range(800)]
    e = encoding.Encoder(encoding.default_path(name), lower, separator)
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for window, near in ((encoding.WINDOW, encoding.NEAR), (64, encoding.NEAR), (64, 8), (200, 3)):
        monkeypatch.setattr(encoding, "WINDOW", window)
        monkeypatch.setattr(encoding, "NEAR", near)
        ids, at = e.encode(pa.array(texts, pa.string()))
        assert [ids[p:q].tolist() for p, q in zip(at, at[1:])] == want
    monkeypatch.setattr(encoding, "CACHE_CHUNKS", 300)
    ids, at = encoding.Encoder(encoding.default_path(name), lower, separator).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for x in want for i in x]


WHITE = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["\u200b", "\ufeff", "\u180e", "\x00", "\u0301", "\u200d", "\uff10"]


@pytest.mark.parametrize("name,lower,separator", [WORD, BYTE])
def test_white_space_at_the_ends_of_rows(name, lower, separator):
    """Each kind of white space alone, before and after words, in every order of rows, as chunks that are learnt together."""
    r = random.Random(8)
    ends = [f"{a}{w}{b}" for w in WHITE for a, b in (("", ""), ("", " b"), ("", "b"), ("a", ""), ("a ", ""), ("", w), ("x", f"{w}y"), ("", "\n"), ("\n", "1"))]
    ends += ["".join(r.choice([*WHITE, " ", "a", "é", "1", ".", "'"]) for _ in range(r.randint(1, 6))) for _ in range(600)]
    for seed in range(4):
        texts = ends + [f"word{i} and more" for i in range(200)]
        random.Random(seed).shuffle(texts)
        e = encoding.Encoder(encoding.default_path(name), lower, separator)
        ids, at = e.encode(pa.array(texts, pa.string()))
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[p:q].tolist() for p, q in zip(at, at[1:])] == want


@pytest.mark.parametrize("name,lower,separator", [WORD, BYTE])
def test_long_chunks_that_hash_alike(name, lower, separator):
    """Strings whose polynomial hashes modulo 2**64 are equal for any base are told apart."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    e = encoding.Encoder(encoding.default_path(name), lower, separator)
    texts = [a, b, f"{a} {b}", b]
    ids, at = e.encode(pa.array(texts))
    assert [ids[p:q].tolist() for p, q in zip(at, at[1:])] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids[at[0] : at[1]].tolist() != ids[at[1] : at[2]].tolist()


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 13, 16, 17, 20, 31, 32])
def test_bit_widths(bits):
    v = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = bitpack.pack(v, bits)
    assert len(data) == -(-1001 * bits // 8) and (bitpack.unpack(data, bits, 1001) == v).all()
    assert bitpack.width(1 << bits) == bits and bitpack.width((1 << bits) + 1) == bits + 1


def test_random_access(tmp_path):
    r = np.random.default_rng(1)
    ids = r.integers(0, 49408, 200_000).astype(np.uint32)
    for bits in (16, 17):
        uri = f"file://{tmp_path}/x{bits}"
        with new_file(uri) as out:
            w = bitpack.Writer(bits, out)
            for p in range(0, 200_000, 30_000):
                part = ids[p : p + 30_000]
                w.add([p], part, np.array([0, len(part)]))
            w.finish()
        f = bitpack.Reader(uri)
        for a, b in ((0, 1), (65_535, 65_537), (10, 199_999), (5, 5), (131_072, 200_000)):
            assert (f.ids(a, b) == ids[a:b]).all()
        assert f.docs == list(range(0, 200_000, 30_000)) and f.total == 200_000


def expected(docs, name, end):
    t = Tokenizer.from_file(encoding.default_path(name))
    rows = sorted((tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [end]) for i, x, _ in rows]


def test_token_files(spark, odd_docs, no_docs):
    start, want = 0, []
    for i, ids in expected(odd_docs, "word_bpe_49k.json", 2):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in bitpack.token_files(odd_docs).orderBy("start").collect()]
    assert got == want
    assert bitpack.token_files(no_docs).count() == 0


def test_shards_in_order(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(300)], "doc_id long, text string").repartition(5)
    m = bitpack.write_shards(docs, encoding.default_path("byte_bpe_50k.json"), 0, rows_per_shard=40)
    assert m.count() > 4
    rows = bitpack.read_shards(spark, m).orderBy("start").collect()
    assert [r.doc_id for r in rows] == list(range(300)) and rows[-1].start + rows[-1].n_tokens == m.agg({"ids": "sum"}).first()[0]


def test_many_rows_of_one_id(spark):
    """Rows without an id, and with one text, are many shards all the same."""
    docs = spark.createDataFrame([(None, "the same text")] * 400 + [(7, f"t{i}") for i in range(400)], "doc_id long, text string").repartition(4)
    m = bitpack.write_shards(docs, encoding.default_path("byte_bpe_50k.json"), 0, rows_per_shard=100)
    assert m.agg({"docs": "sum"}).first()[0] == 800 and m.agg({"docs": "max"}).first()[0] < 250
    rows = bitpack.read_shards(spark, m).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 400 + [7] * 400


def test_rows_that_once_stopped_packing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "\xa0"), (3, "\xa0 b"), (4, "\u3000"), (5, None)], "doc_id long, text string")
    check_pieces(packing.pack_documents(docs).collect(), expected(docs, "byte_bpe_50k.json", 0))


def test_differencing():
    # 8, 7, 6, 5, 4 in two parts differ by 2 after differencing, a known result
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    r = random.Random(1)
    for n, k in ((0, 3), (1, 3), (3, 3), (50, 7), (400, 60)):
        sizes = [r.randint(1, 256) for _ in range(n)]
        parts = packing.differencing(sizes, k)
        assert len(parts) == k and sorted(sum(parts, [])) == list(range(n))
        if n > 2 * k:
            sums = [sum(sizes[i] for i in p) for p in parts]
            assert max(sums) - min(sums) <= 16
    sizes = [600] * 5
    assert len(packing.windows(sizes)) == 5  # three would be enough by their sum
    with pytest.raises(ValueError):
        packing.windows([2000])


def check_pieces(rows, docs):
    want = sorted((i is not None, i or 0, ids) for i, ids in docs)
    pieces = {}
    for r in rows:
        assert r.length * 4 == len(r.ids) and 0 < r.length <= 1024
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in pieces.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    held = {}
    for r in rows:
        held.setdefault(r.doc_id, []).append((r.start, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    for i in {d for d, _ in docs}:
        own = sorted(held[i])
        flat = sorted(t for d, ids in docs if d == i for t in ids)
        assert sorted(t for _, _, ids in own for t in ids) == flat
        if sum(d == i for d, _ in docs) == 1:
            (ids,) = (ids for d, ids in docs if d == i)
            assert [t for _, _, x in own for t in x] == ids and {n for _, n, _ in own} == {len(ids)}
    assert want
    return len(pieces)


def test_packing(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs).collect()
    docs = expected(odd_docs, "byte_bpe_50k.json", 0)
    n = check_pieces(rows, docs)
    assert n <= sum(len(x) for _, x in docs) / 1024 + 2
    assert packing.pack_documents(no_docs).count() == 0
    many = spark.createDataFrame([(i, f"word{i} " * (i % 400)) for i in range(600)], "doc_id long, text string")
    rows = packing.pack_documents(many, docs_per_group=100).collect()
    docs = expected(many, "byte_bpe_50k.json", 0)
    assert check_pieces(rows, docs) <= sum(len(x) for _, x in docs) / 1024 * 1.02 + 6
