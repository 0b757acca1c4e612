"""Steps that many queries share: packages parsed once, Markdown rendered once."""
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.markdown_facts import markdown_lines
from tessera.plans import packages as pk
from tessera.sources import ooxml as ox

LINES = ["Title", "some & text", "third item", "", "last"]


def broken() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document")
        z.writestr("docProps/app.xml", "<q:a/>")          # a prefix without a name space, in a part that nobody reads
    return out.getvalue()


def rows(held, monkeypatch):
    monkeypatch.setattr(ox, "HELD", held)
    made = {"w": pk.word_package(LINES), "s": pk.slide_package(LINES), "x": pk.sheet_package(LINES), "b": broken(), "n": b"none"}
    batch = pa.RecordBatch.from_pydict({"path": list(made), "content": list(made.values())})
    found = list(ox._read([batch]))
    assert all(len(set(b.column("node").to_pylist())) == 1 for b in found)      # a batch is of one kind
    return sorted(map(repr, (r for b in found for r in b.to_pylist())))


def test_held_and_pulled_parts_give_the_same_rows(monkeypatch):
    held = rows(1 << 20, monkeypatch)
    assert held == rows(0, monkeypatch) == rows(900, monkeypatch)
    assert sum("source_invalid" in r for r in held) == 2 and len(held) > 50


@pytest.mark.parametrize("build", [pk.word_package, pk.slide_package, pk.sheet_package])
def test_a_small_part_is_unpacked_once(build, monkeypatch):
    opened = []
    real = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: opened.append(getattr(name, "filename", name)) or real(self, name, *a, **k))
    content = build(LINES)
    opened.clear()
    list(ox._read([pa.RecordBatch.from_pydict({"path": ["p"], "content": [content]})]))
    assert opened and len(opened) == len(set(opened))


def test_markdown_is_rendered_once(spark):
    arms = spark.createDataFrame([(1, "a", "x"), (2, "a", None)], "doc_id long, arm string, text string")
    arms = arms.select("doc_id", "arm", F.concat(F.repeat("text", 3), F.lit("\nend")).alias("markdown"))
    lines = markdown_lines(arms)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(") == 1
    assert [(r.no, r.raw) for r in lines.orderBy("no").collect()] == [(0, "xxx"), (1, "end")]


def test_trim_takes_all_white_space(spark):
    texts = ["", " ", "a b", "\t\n\x0b\x0c\r \x85\xa0       　x y　\n", "​z﻿", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace("t", f"^{tx.WS}+|{tx.WS}+$", "")
    got = df.select(tx.trim_ws(F.col("t")).alias("new"), old.alias("old")).collect()
    assert [r.new for r in got] == [r.old for r in got] == ["", "", "a b", "x y", "​z﻿", None]
    assert "regexp" not in tx.trim_ws(F.col("t"))._jc.toString()
