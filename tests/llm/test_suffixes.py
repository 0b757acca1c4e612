"""Exact substring deduplication against brute force."""
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffixes
from tessera.llm.common import tune

L = suffixes.LENGTH


def brute(texts, first_stays=False):
    """Bytes that remain and removed runs of each text."""
    seen, where = Counter(), {}
    for i, t in enumerate(texts):
        for p in range(len(t) - L + 1):
            seen[t[p:p + L]] += 1
            where.setdefault(t[p:p + L], (i, p))
    out = []
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for p in range(len(t) - L + 1):
            w = t[p:p + L]
            if seen[w] > 1 and not (first_stays and where[w] == (i, p)):
                gone[p:p + L] = b"\1" * L
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((kept, sum(gone), sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))))
    return out


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, line = prose(90), prose(9)
    texts = ["", None, "short", "a" * 700, "ab" * 500, "a" * 199, "a" * 200, prose(300)]
    for k in range(60):
        cut = rng.randint(0, 60)
        texts.append(f"{line} {prose(rng.randint(0, 40))} {shared[cut:] if k % 2 else shared[:-1 - cut]} {prose(rng.randint(0, 40))}")
    near = prose(150).split()
    for _ in range(40):
        own = list(near)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    return texts + [texts[-1], texts[7]]


@pytest.mark.parametrize("first_stays", [False, True])
def test_equals_brute_force(spark, first_stays):
    texts = corpus()
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    got = {r.doc_id: (bytes(r._cut.kept), r._cut.n_removed, r._cut.n_spans)
           for r in suffixes.deduplicate(tune(spark).createDataFrame(rows, "doc_id bigint, text string, start string"), first_stays=first_stays).collect()}
    want = brute([(t or "").encode() for t in texts], first_stays)
    assert len(got) == len(rows)
    for i, w in enumerate(want):
        assert got[i] == w, (i, w[1:], got[i][1:])


def test_repeated_rows_null_keys_and_empty_tables(spark):
    t = "".join(chr(97 + i * i % 23) + " " for i in range(300))
    df = tune(spark).createDataFrame([(1, t), (1, t), (None, t), (None, None), (2, "x" * 150)], "doc_id bigint, text string")
    assert sorted(r._cut.n_removed for r in suffixes.deduplicate(df).collect()) == [0, 0, 600, 600, 600]
    assert sorted(r._cut.n_removed for r in suffixes.deduplicate(df, first_stays=True).collect()) == [0, 0, 554, 600, 600]   # the text repeats itself after 46 bytes
    assert suffixes.deduplicate(df.limit(0)).count() == 0


def test_equal_rows_alone_are_one_copy(spark):
    rng = random.Random(9)
    t, other = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(90)) for _ in range(2))
    df = tune(spark).createDataFrame([(1, t), (1, t), (2, other), (2, other), (3, t)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r._cut.n_removed) for r in suffixes.deduplicate(df, first_stays=True).collect())
    assert got == [(1, 0), (1, 0), (2, 0), (2, 0), (3, len(t))]


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    data = np.frombuffer(random.Random(6).randbytes(9000), np.uint8)
    whole = suffixes.anchors(data)
    for block in (100, 500, 999, 4096):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        assert [x.tolist() for x in suffixes.anchors(data)] == [x.tolist() for x in whole]


@pytest.mark.parametrize("data", [random.Random(6).randbytes(3000), b"a" * 900, b"abc" * 300, b"x" * 200, b"x" * 199, b""])
def test_each_string_has_one_anchor_that_its_bytes_decide(data):
    at, h, lo, hi = (x.tolist() for x in suffixes.anchors(np.frombuffer(data, np.uint8)))
    begins = [p - d for p, a, b in zip(at, lo, hi) for d in range(a, b + 1)]
    assert sorted(begins) == list(range(max(0, len(data) - L + 1)))
    anchor = {p - d: (d, k) for p, k, a, b in zip(at, h, lo, hi) for d in range(a, b + 1)}
    for begin, found in anchor.items():
        alone = suffixes.anchors(np.frombuffer(data[begin:begin + L], np.uint8))
        assert found == (alone[2][0], alone[1][0]) and alone[2][0] == alone[3][0]
