"""Fingerprints, neighbours and pruned Jaccard against plain loops."""
import hashlib
import random

import pytest

from tessera.llm import queries, spots
from tessera.llm.common import tune


def plain_rows(rows, anchors):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        t, other = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        new = t[:len(t) - half] + other[:half]
        a, b, c = (set(spots.signatures(x, anchors).tolist()) for x in (t, new, other))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), "".join(f"{v:08x}" for v in sorted(a)), "".join(f"{v:08x}" for v in sorted(b)), like(a, b), like(a, c)))
    return out


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "and"] + [f"w{k}" for k in range(40)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + rng.choice(["", " é中\n"]) for _ in range(n)]


@pytest.mark.parametrize("ids", [range(30), range(0, 9000, 301), [5, 7, 2000, 2001, 10**15, -4]])
def test_neighbours(spark, ids):
    anchors = frozenset(["the", "of", "and"])
    rows = list(zip(ids, texts(40)[:len(list(ids))]))
    rows[2] = (rows[2][0], None)
    df = tune(spark).createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, id string")
    got = sorted(tuple(r) for r in spots.with_neighbours(df, anchors).collect())
    assert got == sorted(plain_rows(rows, anchors))


def test_null_keys_repeated_rows_one_row_and_none(spark):
    anchors = frozenset(["the"])
    df = tune(spark).createDataFrame([(None, "the a b"), (1, "the a b c"), (1, "the a b c"), (2, "")], "doc_id bigint, text string")
    got = spots.with_neighbours(df, anchors).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2]
    assert {r.near_next for r in got if r.doc_id == 1} == {1.0} and [r.near_next for r in got if r.doc_id is None] == [0.0]
    one = spots.with_neighbours(df.filter("doc_id = 2"), anchors).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].fingerprint == ""
    assert spots.with_neighbours(df.limit(0), spots.common_words(df.limit(0))).count() == 0


def test_chains_follow_anchors():
    s = spots.signatures("the big old dog of man", frozenset(["the", "of"]))
    assert len(s) == 1                             # "of" has one content word after it only
    assert spots.from_text(spots.as_text(s)).tolist() == s.tolist()
    assert len(spots.signatures("no anchor at all", frozenset())) == 1


def test_every_common_word_is_an_anchor_and_long_texts_have_chains(spark):
    common = [f"c{k}" for k in range(100)]
    rows = [(i, " ".join(common) + f" own{i}") for i in range(60)]
    assert spots.common_words(tune(spark).createDataFrame(rows, "doc_id bigint, text string")) == frozenset(common)
    words = [f"w{k}" for k in range(40)]
    own, new = (spots.signatures(" ".join(w), frozenset(["the"])) for w in (words, words[:-1] + ["x"]))
    assert len(own) == 38 and spots.jaccard(own, new) > 0.9


def test_pruned_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    base = [t.split() for t in texts(8, 4)] + [[f"w{k}" if k % 3 else "the" for k in range(70)]]
    rows = []
    for k in range(70):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            if own:
                own[rng.randrange(len(own))] = "w1"
        rows.append((k, " ".join(own)))
    anchors = frozenset(["the", "of", "and"])
    prints = spots.fingerprints(tune(spark).createDataFrame(rows, "doc_id bigint, text string"), anchors)
    pairs, members = spots.similar(prints, 0.6)
    sets = {i: frozenset(spots.signatures(t, anchors).tolist()) for i, t in rows}
    lead = {}
    for i in sorted(sets):
        lead.setdefault(sets[i], i)
    assert {(r.doc_id, r.a) for r in members.collect()} == {(i, lead[s]) for i, s in sets.items()}
    reps = sorted(i for s, i in lead.items() if s)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in reps for b in reps if a < b}
    want = {k: round(v, 9) for k, v in want.items() if v >= 0.6}
    assert {(r.a, r.b): round(r.likeness, 9) for r in pairs.collect()} == want and want


def test_query(spark):
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    anchors = spots.common_words(queries.table(spark, sf, "documents"))
    assert anchors
    assert sorted(tuple(r) for r in queries.QUERIES["op2_spots"](spark, sf).collect()) == sorted(plain_rows(rows, anchors))
