"""Registered queries against DuckDB on the smallest tables: one per area; the rest run the same way."""
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(SF).glob("*.parquet")]
SAMPLE = ["html_facts", "controlled_mutations", "plan_operations", "collision_suffix", "acceptance_join", "render_lists", "render_html_table",
          "char_error_rate", "progress_history", "all_metrics", "document_score", "corpus_compare"]


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return float(v) if isinstance(v, int) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query_and_parses(duck):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    for name, sql in entry_points.oracle_sql().items():
        duck.execute("EXPLAIN " + sql)


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    cur = duck.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: [(x is not None, str(x)) for x in r]
    want = sorted((tuple(map(cell, r)) for r in cur.fetchall()), key=key)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == want
