"""Encoding, decoding and packing against the public tokenizer library."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import bpe, packing, vocab
from tessera.llm.common import tune

ODD = "ab Zé ñ  \x85\x1c\x1d\t\n\r  ''sretll1²½Ⅷ٣_-$|中文字🙂‍\x00"


def texts(n=200):
    rng = random.Random(1)
    out = ["", None, "the the the", " " * 5000 + "x", "a" * 9000, "ab" * 3000, "x<|endoftext|>y <|endoftext|>", "  \n\n  a", "the the the"]
    return out + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocab.default_path())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(texts())]
    return tune(spark).createDataFrame(rows + [(None, "null key", "x", None)], "doc_id bigint, text string, ids string, word binary")


def test_encode_equals_the_library_and_decodes_exactly(docs, library):
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, bpe.lexicon(docs, words=50))).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids == want, r.text
        assert got[r.doc_id].text == library.decode(want, skip_special_tokens=False)


def test_automaton_knows_exactly_its_words(tmp_path):
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    known = words[::2]
    (tmp_path / "a.bin").write_bytes(bpe.compile_words([(w, [len(w), *w]) for w in known]))
    fsa = bpe.Automaton(str(tmp_path / "a.bin"))
    for w, at in zip(words, fsa.find(words).tolist()):
        assert (at >= 0) == (w in set(known))
        if at >= 0:
            assert fsa.ids_at(at) == [len(w), *w]
    assert fsa.find([b"", b"a\0", b"a" * 99]).tolist() == [-1, -1, -1]


def test_suffixes_are_shared(tmp_path):
    (tmp_path / "a.bin").write_bytes(bpe.compile_words([(w, [1]) for w in (b"sing", b"ring", b"king")]))
    assert len(bpe.Automaton(str(tmp_path / "a.bin")).finals) == 5


def test_long_words_merge_like_short_ones():
    _, ranks, _ = vocab.load(vocab.default_path())
    rng = random.Random(3)
    for _ in range(200):
        w = bytes(rng.choice(b"theaiou") for _ in range(rng.randint(1, 60)))
        assert bpe.merge(w, ranks) == bpe._merge_long(w, ranks)


def test_words_merge_side_by_side_like_alone(library):
    path = vocab.default_path()
    _, ranks, _ = vocab.load(path)
    rng = random.Random(5)
    words = [bytes(rng.choice(b"aaabeth \xc3\xa9\xff\x00") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + [b"a" * n for n in range(1, 60)]
    assert [list(np.frombuffer(x, "<i4")) for x in bpe.merge_many(words, path)] == [bpe.merge(w, ranks) for w in words]
    assert bpe.merge_many([], path) == []
    tokens = [t for t in vocab.load(path)[0][:-1]]
    assert [list(np.frombuffer(x, "<i4")) for x in bpe.merge_many(tokens, path)] == [[i] for i in range(len(tokens))]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(none, bpe.lexicon(none)).count() == 0
    assert packing.pack(packing.pieces(none)).count() == 0


def test_packing_holds_every_id_once(docs, library):
    cut = packing.pieces(docs, capacity=64)
    rows = packing.pack(cut, 64).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d in docs.collect():
        own = sorted(by_doc[d.doc_id], key=lambda r: r.start)
        want = np.array(library.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert b"".join(bytes(r.ids) for r in own) == want.tobytes()
        assert all(r.doc_tokens == len(want) and r.length == len(r.ids) // 4 for r in own)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
        padding += 64 - at
    assert padding <= 64
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packing.pack(cut, 64)).collect()}
    assert all(whole[s] == b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.offset)) for s, own in by_seq.items())


def test_best_fill_is_the_closest_sum():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room, sums = rng.randint(0, 60), {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
        used = packing.best_fill(counts, room)
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


def test_query_digests(spark, library):
    import pyarrow.parquet as pq

    from tessera.llm import queries
    sf = "/root/testdata/sf0.001"
    source = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    for r in queries.QUERIES["op1_bpe"](spark, sf).collect():
        ids = library.encode(source[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(source[r.doc_id].encode()).hexdigest()
    for r in queries.QUERIES["op6_packing"](spark, sf).collect():
        ids = np.array([*library.encode(source[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
