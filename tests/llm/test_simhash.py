"""Fingerprints and their components against brute force."""
import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from tessera.llm import simhash
from tessera.llm.common import components, tune


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(values, distance):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_fingerprint_is_the_stated_one():
    rng = random.Random(1)
    for _ in range(100):
        t = "".join(rng.choice("aB É\x85 \t\n\x0b中 ") for _ in range(rng.randint(0, 60)))
        assert simhash.simhash(t) == plain(t)
    assert simhash.simhash("") == simhash.simhash(" \n") == 0


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)     # grids of chunks are used as well
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {0, *centres}
    for c in centres:
        for _ in range(40):
            values.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = tune(spark).createDataFrame([(signed(v),) for v in values], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = brute(values, 4)
    got = {}
    for v in values:
        got.setdefault(roots.get(signed(v), signed(v)), set()).add(v)
    expected = {}
    for v, r in want.items():
        expected.setdefault(r, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(80))
    rows = [(5, base, 1), (9, base.upper(), 1), (7, base + " end", 1), (3, None, 1), (4, "", 1), (8, " \n", 1), (9, base.upper(), 1), (10, "alone in the world", 1)]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, fp int")).collect())
    prints = {i: plain(t or "") for i, t, _ in rows}
    roots = brute(set(prints.values()), 4)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert got == sorted((i, least[roots[prints[i]]]) for i, _, _ in rows)
    none = simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"))
    assert none.count() == 0


def test_one_of_each_is_by_five_word_jaccard(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)      # grids of chunks are used as well
    rng = random.Random(7)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        for k in range(6):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(900, "four words are one"), (901, "Four  words are ONE"), (902, "other words are one"), (903, None), (904, " ")]

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    pairs = [(a, b) for a in sets for b in sets if a < b and (len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 8)]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = simhash.one_of_each(tune(spark).createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted({find(i) for i in root}) and len(got) < 120


def test_long_chain(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "u bigint, v bigint")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(1, n + 1)}
    assert np.bitwise_count(np.uint64(7)) == 3


def test_recall_of_near_copies_on_the_given_table(spark):
    """Pairs of different sets with a five-word Jaccard of 0.8 or more, found over an inverted index of all shingles."""
    from collections import Counter, defaultdict
    from itertools import combinations

    from pyspark.sql import functions as F

    docs = tune(spark).read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        sets.setdefault(frozenset(simhash.shingle_hashes(r.text or "").tolist()), r.doc_id)
    ids = {i: s for s, i in sets.items() if s}
    holders = defaultdict(list)
    for i, s in ids.items():
        for h in s:
            holders[h].append(i)
    shared = Counter()
    for own in holders.values():
        if 1 < len(own) <= 40:                      # a shingle that more texts hold adds no candidate of its own
            shared.update(combinations(sorted(own), 2))
    near = [(a, b) for a, b in shared if len(ids[a] & ids[b]) * 10 >= len(ids[a] | ids[b]) * 8]
    kept = docs.filter(F.col("doc_id").isin(sorted({i for p in near for i in p})))
    named = kept.withColumns({"_near_id": F.col("doc_id"), "_near_sig": F.xxhash64("text"), "_near_text": F.col("text")})
    prints = simhash.keep(named.select("_near_id", "_near_sig", simhash.sketch(F.col("text")).alias("s")).select("_near_id", "_near_sig", "s.fp", "s.bands"))
    group = {r._near_id: r.group for r in prints.join(simhash.similar_groups(named, prints), "fp").collect()}
    found = sum(group[a] == group[b] for a, b in near)
    print("near pairs", len(near), "joined", found)
    assert len(near) >= 20 and found >= 0.9 * len(near)


def test_near_copies_come_from_linked_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: [])      # fingerprints alone
    base = [f"w{i}" for i in range(2000)]
    texts = {1: " ".join(base), 2: " ".join(base[:-1] + ["other"]), 3: " ".join(reversed(base)), 4: "", 5: None}
    bits = (simhash.simhash(texts[1], 5) ^ simhash.simhash(texts[2], 5)).bit_count()
    got = simhash.one_of_each(tune(spark).createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert bits <= simhash.DISTANCE and sorted(r.doc_id for r in got) == [1, 3, 4]
