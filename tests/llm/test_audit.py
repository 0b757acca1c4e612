"""Filter interaction audit against plain Python, over every order."""
import re
from itertools import permutations

import duckdb

from tessera.llm import audit
from tessera.llm.common import tune

LONG = " ".join(f"w{i}" for i in range(120))


def fails(i, text, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
    return out | ({"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else set())


def brute(rows, labels):
    out = []
    for part in {lang or "" for _, _, lang in rows}:
        own = [(i, fails(i, t or "", rows)) for i, t, lang in rows if (lang or "") == part]
        good, bad = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
        table, total = [], dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            left = list(own)
            for s, f in enumerate(p):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                table.append((part, "".join(p), s + 1, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own),
                              sum(x[0] in good for x in gone), sum(x[0] in bad for x in gone), f))
        out += [(*r[:-1], total[r[-1]]) for r in table]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_equals_plain_python(spark):
    rows = [(1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (0, LONG, "fr"), (3, LONG + " #", "en"), (4, "a a a a", "en"), (5, "SHOUT", None), (6, None, ""), (7, "", "en"),
            (None, LONG, "en"), (None, "", None), (8, "a a a a", "fr"), (9, LONG.upper(), "fr"), (10, LONG * 400, "fr"), (11, LONG * 400, "fr"), (12, "x\x0by z & é", "en"), (13, "A" + "b" * 9, "fr"), (14, "A" + "b" * 8, "fr")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (99, 1, 1), (8, 1, 1)]
    docs = tune(spark).createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, lang string, bits int, n int")
    known = spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    assert rows_of(audit.audit(docs, known)) == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], docs.schema)
    got = rows_of(audit.audit(one, labels))
    assert len(got) == 600 and sum(r[4] for r in got) == 120 and {r[-1] for r in got if r[4]} == {120}


def test_large_group_of_copies_meets_one_row(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, concat('t', id), 'copy') as text", "'en' as lang")
    late = audit.combinations(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert sum(r.n for r in late if r.bits & 16) == 1999 and sum(r.n for r in late) == 3000


def test_equals_sql_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = rows_of(audit.audit(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))))
    assert got == sorted(con.execute(audit.SQL).fetchall()) and len(got) % 600 == 0
