"""Planning, reports, sources, sinks, packages, streams."""
import io
import json
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import jsontext
from tessera.operators import harness as hs
from tessera.operators import inventory as inv
from tessera.operators import ooxml_facts as of
from tessera.operators import reports as rp
from tessera.sources import files as src
from tessera.sources import sinks
from tessera.sources.ooxml import ooxml_parts, source_status
from tessera.streaming.convert import convert_stream
from tessera.streaming.progress import progress_stream


def files(spark, *paths):
    return spark.createDataFrame([("/r/" + p, p, 10) for p in paths], "source_path string, relative_path string, size_bytes bigint")


def no_targets(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "target_path string")


def brute_force_names(targets):
    """Greedy naming in path order, the meaning of collision suffixes."""
    used, out = set(), []
    for t in targets:
        name, suffix = t, 2
        while name.lower() in used:
            stem, ext = t.rsplit(".", 1)
            name, suffix = f"{stem}-{suffix}.{ext}", suffix + 1
        used.add(name.lower())
        out.append(name)
    return out


@pytest.mark.parametrize("paths", [
    ["a.docx", "a.pdf", "a.txt", "a-2.txt", "A.pptx", "b.txt"], ["a-2.txt", "a.docx", "a.pdf", "a.txt", "a-3.docx", "a-2-2.txt"]])
def test_collisions_match_the_greedy_meaning(spark, paths):
    ops = inv.plan_operations(files(spark, *paths), no_targets(spark), "/r", "/o")
    got = {r.relative_path: r.target_path for r in inv.collision_suffix(ops, no_targets(spark)).collect()}
    order = sorted(paths, key=lambda p: (p.lower(), p))
    assert [got[p] for p in order] == brute_force_names(["/o/" + p.rsplit(".", 1)[0] + ".md" for p in order])


def test_names_against_the_greedy_loop(spark):
    rng = random.Random(8)
    for trial in range(4):
        stems = ["a", "a-2", "a-3", "a-2-2", "a-2-2-2", "a-4", "b", "b-2", "a-02", "a-1", "A-2", "c", "c-2.x", "-2", ""]
        paths = sorted({f"{rng.choice(['', 'p/', 'q/'])}{rng.randint(0, 99)}{rng.choice('xyz')}" for _ in range(120)})
        targets = {p: f"/o/{rng.choice(stems)}.md" for p in paths}
        ops = spark.createDataFrame([(p, t, "Ready", True) for p, t in targets.items()], "relative_path string, target_path string, status string, adapter_available boolean")
        got = {r.relative_path: r.target_path for r in inv.collision_suffix(ops, no_targets(spark)).collect()}
        order = sorted(paths, key=lambda p: (p.lower(), p))
        assert [got[p] for p in order] == brute_force_names([targets[p] for p in order]), trial


def test_long_chains_take_no_more_rounds(spark, monkeypatch):
    """Every child comes first and every claimant has to go past all of them."""
    from tessera.operators import naming
    from tessera.session import cut_lineage
    cuts = []
    for module in (inv, naming):
        monkeypatch.setattr(module, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    counts = []
    for n in (6, 400):
        paths = [f"a{i:04}" for i in range(n)] + [f"b{i:04}" for i in range(n)]
        targets = [f"/o/x-{i + 2}.md" for i in range(n)] + ["/o/x.md"] * n
        ops = spark.createDataFrame([(p, t, "Ready", True) for p, t in zip(paths, targets)], "relative_path string, target_path string, status string, adapter_available boolean")
        cuts.clear()
        got = {r.relative_path: r.target_path for r in inv.collision_suffix(ops, no_targets(spark)).collect()}
        assert [got[p] for p in paths] == brute_force_names(targets)
        counts.append(len(cuts))
    assert counts[0] == counts[1]


def test_names_cut_to_length_still_differ(spark):
    stem = "n" * 196
    targets = [f"/o/{stem}{x}.md" for x in ("a", "b", "a", "b", "a")]
    ops = spark.createDataFrame([(f"p{i}", t, "Ready", True) for i, t in enumerate(targets)], "relative_path string, target_path string, status string, adapter_available boolean")
    got = [r.target_path for r in inv.collision_suffix(ops, no_targets(spark)).orderBy("relative_path").collect()]
    assert len({t.lower() for t in got}) == 5 and got[:2] == targets[:2] and all(len(t) <= 3 + inv.MAX_NAME for t in got)


def test_plan_precedence(spark):
    ops = inv.plan_operations(files(spark, "x.zip", "../e.txt", "c.txt", "w.doc", "t.TXT", "i.png"), no_targets(spark, "/o/C.md"), "/r", "/o")
    got = {r.relative_path: (r.status, r.target) for r in ops.collect()}
    assert got == {"x.zip": ("Skipped", "Skip"), "../e.txt": ("Failed", "Markdown"), "c.txt": ("Conflict", "Markdown"),
                   "w.doc": ("EngineUnavailable", "Docx"), "t.TXT": ("Ready", "Markdown"), "i.png": ("Ready", "Copy")}


def test_sheet_names(spark):
    sheet = "array<struct<name:string,index:int,visibility:string,is_empty:boolean>>"
    sheets = [(n, i + 1, "visible", False) for i, n in enumerate(["Summary", "Sales:2026", "Sales?2026", "CON", "Trailing. "])]
    books = spark.createDataFrame([("/r/sales.xlsx", "sales.xlsx", sheets, None), ("/r/none.xls", "none.xls", [], None), ("/r/bad.xls", "bad.xls", None, "e")],
                                  f"source_path string, relative_path string, worksheets {sheet}, inspection_error string")
    rows = inv.plan_worksheets(books, no_targets(spark), "/o").collect()
    assert sorted(r.target_path for r in rows if r.relative_path == "sales.xlsx") == sorted(
        "/o/" + n for n in ["sales__Summary.csv", "sales__Sales_2026.csv", "sales__Sales_2026-2.csv", "sales___CON.csv", "sales__Trailing.csv"])
    assert {r.relative_path: r.message for r in rows if r.relative_path != "sales.xlsx"} == {"none.xls": "worksheet_none", "bad.xls": "worksheet_inspection_failure"}


def test_whole_plan_gives_every_operation_its_own_target(spark):
    sheet = "array<struct<name:string,index:int,visibility:string,is_empty:boolean>>"
    names = {"s.xlsx": ["A", "a", "A-2", "E"], "s.xls": ["A"], "t/s.xlsx": ["A", "B"], "none.xlsx": []}
    books = spark.createDataFrame([(p, [(n, i + 1, "visible", n == "E") for i, n in enumerate(v)], None) for p, v in names.items()],
                                  f"relative_path string, worksheets {sheet}, inspection_error string")
    found = files(spark, *names, "s__a.txt", "d.docx", "d.pdf")
    rows = inv.plan_batch(found, books, no_targets(spark), "/r", "/o", [("Xls", "Csv"), ("Xlsx", "Csv"), ("Xlsx", "Csv")]).collect()
    targets = [r.target_path.lower() for r in rows if r.target_path]
    assert len(rows) == 11 and len(set(targets)) == len(targets)
    order = sorted((r for r in rows if r.target_path), key=lambda r: (r.relative_path.lower(), r.relative_path, r.sheet_index))
    wanted = []
    for r in order:
        stem = r.relative_path.rsplit(".", 1)[0]
        own = names.get(r.relative_path)
        earlier = [] if own is None else [n.lower() for n in own[:r.sheet_index - 1]].count(own[r.sheet_index - 1].lower())
        wanted.append(f"/o/{stem}.md" if own is None else f"/o/{stem}__{own[r.sheet_index - 1]}{f'-{earlier + 1}' if earlier else ''}.csv")
    assert [r.target_path for r in order] == brute_force_names(wanted)
    assert {r.status for r in rows if r.sheet_name == "E"} == {"Skipped"} and [r.status for r in rows if r.relative_path == "none.xlsx"] == ["Skipped"]


def test_output_validation(spark):
    rows = [("1", "Docx", b"PK", 1, ["[Content_Types].xml", "word/document.xml"], None), ("2", "Docx", b"PK", 1, ["x"], "ooxml_structure_invalid"),
            ("3", "Pdf", b"%PDF-1.7", 1, None, None), ("4", "Pdf", b"nope", 1, None, "pdf_signature_invalid"), ("5", "Markdown", b"\xff\xfe\xff", 1, None, "output_invalid_utf8"),
            ("6", "Markdown", b"", 0, None, None), ("7", "Markdown", b"", 1, None, "output_empty"), ("8", "Markdown", b" \n", 1, None, "output_empty"),
            ("9", "Txt", None, 1, None, "output_missing"), ("10", "Other", b"x", 1, None, "unsupported_output_validation"), ("11", "Txt", b"", 1, None, "output_empty")]
    df = spark.createDataFrame([tuple(r[:5]) for r in rows], "path string, target string, content binary, source_length bigint, parts array<string>")
    assert {r.path: r.error_code for r in inv.validate_output(df).collect()} == {r[0]: r[5] for r in rows}


def test_readers(spark, tmp_path):
    root = tmp_path / "in"
    (root / "_converted").mkdir(parents=True)
    for name, data in {"a.txt": "x\r\ny\rz".encode("utf-8-sig"), "b.txt": b"\xff\xfeh\x00", "c.txt": b"\xff\xff\xff", "~$l.docx": b"1", "_converted/o.md": b"2"}.items():
        (root / name).write_bytes(data)
    scanned = src.scan_inventory(spark, str(root), excluded_directory="_converted")
    assert {(r.relative_path, r.size_bytes) for r in scanned.collect()} == {("a.txt", 9), ("b.txt", 4), ("c.txt", 3)}
    text = {r.path: (r.text, r.error_code) for r in src.decode_strict(src.read_content(spark, str(root))).collect()}
    assert text["a.txt"] == ("x\r\ny\rz", None) and text["b.txt"] == ("h", None) and text["c.txt"] == (None, "text_encoding_unsupported")
    wide = spark.createDataFrame([("p", bytearray("a\t\u00fc".encode("utf-16")))], "path string, content binary")
    assert bytes(src.transcode_utf16_utf8(wide).first().content).decode() == "a\t\u00fc"
    (tmp_path / "m.json").write_text(json.dumps({"profileId": "p", "files": [{"path": "x", "sha256": "h", "sizeBytes": 3}],
                                                 "formats": {"txt": {"status": "S", "metrics": ["m"], "findings": ["f"]}, "html": {"status": "N", "metrics": [], "findings": []}}}))
    assert [tuple(r) for r in src.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("p", "x", "h", 3)]
    assert {(r.format, r.rule_name) for r in src.read_profile(spark, str(tmp_path / "m.json")).collect()} == {("txt", "m"), ("txt", "f"), ("html", None)}
    (tmp_path / "r.tsv").write_text("input\textension\texit_code\toutput_sha256\treport_sha256\tduration_ms\na\ttxt\t0\tff\tee\t5\nb\tpdf\t2\t\t\t7\n")
    assert tuple(hs.lab_summary(src.read_lab_results(spark, str(tmp_path / "r.tsv"))).first()) == (2, 1, 1)
    (tmp_path / "s.json").write_text(json.dumps([{"arm": "direct", "fixture": "F1", "duration_seconds": 0.5, "success": True, "char_count": 3, "provenance": {"num_pages": 2}}]))
    run = src.read_run_results(spark, str(tmp_path / "s.json")).first()
    assert run.fixture == "F1" and run.provenance.num_pages == 2


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("b", "s", 0, 0, "x,1"), ("b", "s", 0, 1, "y"), ("b", "s", 1, 1, "z")], "workbook string, sheet string, row int, col int, value string")
    sinks.write_sheet_delimited(cells, str(tmp_path / "csv"))
    lines = lambda kind, sheet: "".join(p.read_text() for p in sorted((tmp_path / kind / "workbook=b" / f"sheet={sheet}").glob("part-*")))
    assert lines("csv", "s") == '"x,1",y\n,z\n'
    wide = spark.createDataFrame([("b", "s", 0, 0, "a\tb"), ("b", "s", 3, 1, 'q"'), ("b", "w", 0, 4, "far")], "workbook string, sheet string, row int, col int, value string")
    sinks.write_sheet_delimited(wide, str(tmp_path / "tsv"), "tsv")
    assert lines("tsv", "s") == '"a\tb"\t\n\t\n\t\n\t"q"""\n' and lines("tsv", "w") == "\t\t\t\tfar\n"
    runs = spark.createDataFrame([("k1",), ("k2",)], "evidence_key string")
    sinks.append_run_registry(runs, spark.createDataFrame([("k1",)], "evidence_key string"), str(tmp_path / "reg"))
    assert [r.evidence_key for r in spark.read.parquet(str(tmp_path / "reg")).collect()] == ["k2"]


def report_of(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def test_one_published_report(spark, tmp_path):
    header = spark.createDataFrame([("1.0", None)], "schema_version string, product_name string")
    counts = spark.createDataFrame([(3, 1)], "total int, not_processed int")
    errors = spark.createDataFrame([("z", "no access"), ("a", 'say "x"')], "relative_path string, message string")
    items = spark.createDataFrame([(f"f{i:04}", "Failed" if i % 2 else "Succeeded", [("primary", f"o{i}", None)]) for i in range(2000)],
                                  "source_relative_path string, status string, artifacts array<struct<kind:string,relativePath:string,sha256:string>>").repartition(7)
    path = tmp_path / "report"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_report_json(header, counts, errors, items, str(path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = report_of(path)
    assert len(list(path.glob("part-*"))) > 1 and list(got) == ["schemaVersion", "counts", "scanErrors", "items"] and got["counts"] == {"total": 3, "notProcessed": 1}
    assert got["scanErrors"] == [{"relativePath": "a", "message": 'say "x"'}, {"relativePath": "z", "message": "no access"}]
    assert [i["sourceRelativePath"] for i in got["items"]] == [f"f{i:04}" for i in range(2000)] and got["items"][3] == {
        "sourceRelativePath": "f0003", "status": "Failed", "artifacts": [{"kind": "primary", "relativePath": "o3"}]}
    with pytest.raises(FileExistsError):
        sinks.write_report_json(header, counts, errors, items, str(path))
    assert report_of(path) == got


def test_failing_report_leaves_nothing_and_blocks_nothing(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "n int")
    broken = one.select(F.raise_error(F.lit("lost")).cast("string").alias("x"))
    path = tmp_path / "report"
    with pytest.raises(Exception, match="lost"):
        sinks.write_report_json(one, one, one, broken, str(path))
    assert not list(tmp_path.iterdir())
    sinks.write_report_json(one.select(), one, one.limit(0), one.limit(0), str(path))
    assert report_of(path) == {"counts": {"n": 1}, "scanErrors": [], "items": []} and [p.name for p in tmp_path.iterdir()] == ["report"]


def test_scan_keeps_errors(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a/b/c").mkdir(parents=True)
    (root / "_converted/x").mkdir(parents=True)
    for name in ("top.txt", "a/one.docx", "a/b/c/deep.md", "a/~$one.docx", "_converted/x/no.md", "a/b/skip.csv"):
        (root / name).write_text(name)
    (root / "link").symlink_to(root / "a")
    (root / "l.txt").symlink_to(root / "top.txt")
    (tmp_path / "rootlink").symlink_to(root)
    rows = lambda found: sorted((r.relative_path, r.size_bytes) for r in found[0].collect())
    said = lambda found: sorted((r.relative_path, r.message) for r in found[1].collect())
    found = src.scan_folder(spark, f"file://{root}", True, "_converted", "a/b/SKIP.csv")
    assert rows(found) == [("a/b/c/deep.md", 13), ("a/one.docx", 10), ("top.txt", 7)] and said(found) == []
    assert rows(src.scan_folder(spark, str(root), False)) == [("top.txt", 7)]
    assert said(src.scan_folder(spark, str(tmp_path / "none"))) == [("", src.MISSING)] and said(src.scan_folder(spark, str(tmp_path / "rootlink"))) == [("", src.LINKED)]
    assert list(src._entries(str(root / "gone"), False)) == [("error", str(root / "gone"), None, src.DENIED)]
    nothing = rp.batch_verdict(spark.createDataFrame([("Succeeded", "PASS", "PASS")], "status string, source_integrity string, artifact_integrity string"), src.scan_folder(spark, str(tmp_path / "none"))[1])
    assert (nothing.first().n_errors, nothing.first().final_state) == (1, "COMPLETED_WITH_ISSUES")


def test_json_text(spark):
    df = spark.createDataFrame([('{"a":1.50,"a":[1e3,{}],"b":"\u00fc"}',), ("{",), ("NaN",), ("[]",)], "j string")
    got = [r.t for r in df.select(jsontext.json_to_text(F.col("j")).alias("t")).collect()]
    assert got == ['{\n  "a": 1.50,\n  "a": [\n    1e3,\n    {}\n  ],\n  "b": "\u00fc"\n}', None, None, "[]"]


def package(parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return bytearray(buf.getvalue())


NS = ('xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
      'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
      'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"')
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>'


def parts_of(spark, parts):
    df = spark.createDataFrame([("d", package(parts)), ("broken", bytearray(b"no zip"))], "path string, content binary")
    return ooxml_parts(df).cache()


def facts(df):
    return [(r.kind, r.text, r.certainty, r.attributes or {}) for r in df.orderBy("ord").collect()]


def test_word_package(spark):
    p = lambda text, ppr="": f"<w:p><w:pPr>{ppr}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    num = lambda n, l=None: f'<w:numPr>{"" if l is None else f"<w:ilvl w:val=%s/>" % chr(34).join(["", str(l), ""])}<w:numId w:val="{n}"/></w:numPr>'
    doc = (p("Out", '<w:outlineLvl w:val="1"/>') + p("Styled", '<w:pStyle w:val="H"/>') + p("Named", '<w:pStyle w:val="heading 3"/>')
           + p("direct", num(5, 1)) + p("inherited", '<w:pStyle w:val="Child"/>') + p("cancelled", '<w:pStyle w:val="Child"/>' + num(0)) + p("loop", '<w:pStyle w:val="Loop"/>')
           + '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc><w:tc><w:p><w:hyperlink r:id="r1"><w:r><w:t>go</w:t></w:r></w:hyperlink></w:p></w:tc></w:tr></w:tbl>'
           + '<w:p><w:r><w:drawing><a:blip r:embed="r2"/></w:drawing></w:r></w:p>')
    style = lambda i, extra="": f'<w:style w:styleId="{i}">{extra}</w:style>'
    parts = parts_of(spark, {
        "word/document.xml": f"<w:document {NS}><w:body>{doc}</w:body></w:document>",
        "word/styles.xml": f"<w:styles {NS}>" + style("H", '<w:name w:val="Heading 1"/>') + style("Base", f"<w:pPr>{num(7)}</w:pPr>")
        + style("Child", '<w:basedOn w:val="base"/>') + style("Loop", '<w:basedOn w:val="Loop"/>') + "</w:styles>",
        "word/numbering.xml": f'<w:numbering {NS}><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="2"><w:pStyle w:val="Base"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="3"/></w:num></w:numbering>',
        "word/_rels/document.xml.rels": RELS % '<Relationship Id="r1" Target="https://x/"/><Relationship Id="r2" Target="media/i.png"/>'})
    assert [r.error_code for r in parts.filter("path = 'broken'").collect()] == ["source_invalid"]
    got = facts(of.docx_facts(parts))
    assert [(k, t, c, a.get("level")) for k, t, c, a in got] == [
        ("HEADING", "Out", "SOURCE_EXACT", "2"), ("HEADING", "Styled", "DERIVED_EXACT", "1"), ("HEADING", "Named", "DERIVED_EXACT", "3"),
        ("LIST_ITEM", "direct", "SOURCE_EXACT", "1"), ("LIST_ITEM", "inherited", "DERIVED_EXACT", "2"), ("TEXT_BLOCK", "cancelled", "SOURCE_EXACT", None),
        ("TEXT_BLOCK", "loop", "SOURCE_EXACT", None), ("TABLE", None, "SOURCE_EXACT", None), ("TABLE_CELL", "wide", "SOURCE_EXACT", None),
        ("TABLE_CELL", "go", "SOURCE_EXACT", None), ("LINK", "go", "SOURCE_EXACT", None), ("TEXT_BLOCK", "", "SOURCE_EXACT", None), ("IMAGE", None, "SOURCE_EXACT", None)]
    assert got[4][3]["numberingSource"] == "style:base" and got[9][3]["column"] == "2" and got[7][3]["columns"] == "3" and got[10][3]["target"] == "https://x/"


def test_slide_and_sheet_packages(spark):
    para = lambda t, ppr="": f"<a:p>{ppr}<a:r><a:t>{t}</a:t></a:r></a:p>"
    shape = lambda body, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>"
    slide = lambda *s: f"<p:sld {NS}><p:cSld><p:spTree>{''.join(s)}</p:spTree></p:cSld></p:sld>"
    parts = parts_of(spark, {
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS % '<Relationship Id="a" Target="slides/slide1.xml"/><Relationship Id="b" Target="slides/slide2.xml"/>',
        "ppt/slides/slide1.xml": slide(shape(para("plain") + para(" "))),
        "ppt/slides/slide2.xml": slide(shape(para("Title"), '<p:ph type="title"/>'), shape(para("item", '<a:pPr lvl="1"><a:buChar char="-"/></a:pPr>')))})
    assert [(k, t, c, a.get("level")) for k, t, c, a in facts(of.pptx_facts(parts))] == [
        ("HEADING", "Title", "DERIVED_EXACT", "1"), ("LIST_ITEM", "item", "SOURCE_EXACT", "1"), ("TEXT_BLOCK", "plain", "SOURCE_EXACT", None)]
    c = lambda ref, v, extra="": f'<c r="{ref}" {extra}><v>{v}</v></c>'
    sheet = (f'<worksheet {NS}><sheetData><row r="1">{c("A1", 0, "t=%ss%s" % (chr(34), chr(34)))}{c("B1", 42)}</row>'
             f'<row r="3">{c("A3", "1.5", "s=%s1%s" % (chr(34), chr(34)))}<c r="C3"><f>1+1</f><v>2</v></c>{c("D3", 1, "t=%sb%s" % (chr(34), chr(34)))}</row></sheetData></worksheet>')
    parts = parts_of(spark, {
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="Data" r:id="x"/><sheet name="Empty" r:id="y"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS % '<Relationship Id="x" Target="worksheets/sheet1.xml"/><Relationship Id="y" Target="/xl/worksheets/sheet2.xml"/>',
        "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": f"<worksheet {NS}><sheetData/></worksheet>",
        "xl/sharedStrings.xml": f"<sst {NS}><si><r><t>He</t></r><r><t>llo</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="2"/></cellXfs></styleSheet>'})
    rows = of.xlsx_facts(parts).orderBy("ord").collect()
    assert [(r.fact_id, r.text, (r.property_certainty or {}).get("text")) for r in rows] == [
        ("table:1", None, None), ("table:1:cell:0:0", "Hello", "SOURCE_EXACT"), ("table:1:cell:0:1", "42", "DERIVED_EXACT"),
        ("table:1:cell:2:0", "1.5", "INFERRED"), ("table:1:cell:2:2", "2", "INFERRED"), ("table:1:cell:2:3", "TRUE", "DERIVED_EXACT")]
    assert rows[0].attributes == {"sheet": "Data", "rows": "3", "nonEmptyRows": "2", "columns": "4"}
    assert rows[3].attributes["valueSemantics"] == "displayed-formatted-numeric-unverified"


def test_streams(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.txt").write_text('{"id":"a","text":"x\\r\\ny","sourceFormat":"txt"}\nnot json\nnot json\n\n{"id":"b","text":"q","sourceFormat":"gif"}\n')
    run = lambda: convert_stream(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    (inbox / "2.txt").write_text('{"id":"a","text":"again","sourceFormat":"txt"}\n{"id":"c","text":"z","sourceFormat":"TXT"}\n')
    run()
    rows = sorted((r.id, r.success, r.error_code or "", r.markdown or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [("a", True, "", "again"), ("a", True, "", "x\ny"), ("b", False, "unsupported_format", ""), ("c", True, "", "z"),
                    ("unknown", False, "invalid_request", ""), ("unknown", False, "invalid_request", "")]
    spark.createDataFrame([(1, 10, False, 0), (1, 150, False, 60), (2, 5, True, 5), (1, 40, False, 30)], "operation int, pct int, success boolean, s int").select(
        "operation", "pct", "success", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("operation int, pct int, success boolean, ts timestamp").parquet(str(tmp_path / "ev"))
    q = progress_stream(stream).writeStream.outputMode("update").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.operation, r.percent) for r in spark.table("progress").collect()} == {(1, 99), (2, 100)}


def test_progress_survives_midnight(spark, tmp_path):
    write = lambda rows, name: spark.createDataFrame(rows, "operation int, pct int, success boolean, s long").select(
        "operation", "pct", "success", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "ev" / name))
    write([(1, 90, False, 86_000)], "a")
    stream = spark.readStream.schema("operation int, pct int, success boolean, ts timestamp").parquet(str(tmp_path / "ev" / "*"))
    run = lambda: progress_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(
        lambda batch, n: batch.write.mode("append").json(str(tmp_path / "out"))).trigger(availableNow=True).start().awaitTermination(90)
    run()
    write([(1, 10, False, 86_500)], "b")
    run()
    assert [r.percent for r in spark.read.json(str(tmp_path / "out")).collect()] == [90, 90]


def test_malformed_sources_keep_a_row(spark, tmp_path):
    raw = [("ok", b"\xff\xfeh\x00"), ("odd", b"\xff\xfeh\x00i"), ("lone", b"\xff\xfe\x00\xd8"), ("low", b"\xfe\xff\xdc\x00"), ("pair", "\ufeff\U0001f600x".encode("utf-16-be")), ("none", None)]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in raw], "path string, content binary")
    got = {r.path: (r.text, r.error_code) for r in src.decode_strict(df).collect()}
    bad = (None, "text_encoding_unsupported")
    assert got == {"ok": ("h", None), "odd": bad, "lone": bad, "low": bad, "pair": ("\U0001f600x", None), "none": bad}
    out = {r.path: (r.content, r.error_code) for r in src.transcode_utf16_utf8(df).collect()}
    assert bytes(out["ok"][0]) == b"h" and out["odd"] == bad and out["lone"] == bad
    (tmp_path / "big.txt").write_bytes(b"x" * 50)
    (tmp_path / "small.txt").write_bytes(b"y")
    rows = {r.path: (r.text, r.error_code) for r in src.decode_strict(src.read_content(spark, str(tmp_path), max_bytes=10)).collect()}
    assert rows == {"big.txt": (None, "resource_limit"), "small.txt": ("y", None)}


def test_malformed_packages_keep_a_row(spark):
    body = '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="x"/></w:tcPr><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    good = package({"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>"})
    rows = [("good", good), ("zip", bytearray(b"PK")), ("xml", package({"word/document.xml": "<w:document"})), ("null", None)]
    parts = ooxml_parts(spark.createDataFrame(rows, "path string, content binary")).cache()
    assert [(r.doc_id, r.text) for r in of.docx_facts(parts).filter("kind = 'TABLE_CELL'").collect()] == [("good", "cell")]
    status = {r.path: (r.status, r.first_broken) for r in source_status(parts).collect()}
    invalid = "NOT_EVALUATED_SOURCE_INVALID"
    assert status == {"good": ("EVALUATED", None), "zip": (invalid, "package"), "xml": (invalid, "word/document.xml"), "null": (invalid, "package")}


def test_traversal_is_found_at_any_depth(spark):
    paths = ["a/b/../../../x", "a\\..\\..\\x", "../x", "a/../x", "./a/./x", "/x", "C:x", "a/b/../../x"]
    m = spark.createDataFrame([("r", p, "h", 1) for p in paths], "run_id string, path string, sha256 string, size_bytes long")
    got = {r.path: r.status for r in rp.verify_artifacts(m, m)[0].collect()}
    assert [got[p] for p in paths] == ["INVALID_PATH"] * 3 + ["PASS"] * 2 + ["INVALID_PATH"] * 2 + ["PASS"]


def test_edit_distance_against_the_table(spark):
    from tessera.functions import text as tx

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(6)
    for _ in range(1500):
        a = "".join(rng.choice("abc\u00e9") for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice("abc\u00e9") for _ in range(rng.randint(0, 40))) if rng.random() < 0.5 else "".join(c for c in a if rng.random() < 0.8)
        d = table(a, b)
        assert tx.edit_distance(a, b) == d
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        for k in (1, 2, 5, 13, 40):
            if short and k >= len(long) - len(short):
                found = tx.banded_distance(long, short, k)
                assert found == d if d <= k else found > k, (a, b, k)
    base = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    noisy = "".join(c for c in base if rng.random() > 0.002)
    began = time.time()
    assert tx.edit_distance(base, noisy) == len(base) - len(noisy) and time.time() - began < 10
    rows = [(base[:3000], noisy[:3000]), ("abc", "abd"), ("", "x"), (None, "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.d for r in df.select(tx.edits(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [spark.sql("SELECT levenshtein('%s', '%s') d" % rows[0]).first().d, 1, 1, None]


def test_canonical_links_have_no_dot_segments(spark):
    from tessera.functions import url
    links = {"http://h/a/./b/../c": "http://h/a/c", "HTTP://H/../x/..": "http://h/", "http://h/a/..?q=../x": "http://h/?q=../x", "http://h/a/.": "http://h/a/", "http://h/...": "http://h/...",
             "https://h/a/b/../../../c/": "https://h/c/", "../x": "../x"}
    got = spark.createDataFrame([(k,) for k in links], "u string").select("u", url.canonical_uri(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == links


def test_stream_restarted_half_way_equals_the_fold(spark):
    import __spark_entry__ as entry_points
    sf = "/root/testdata/sf0.001"
    rows = lambda name: sorted(tuple(r) for r in entry_points.queries()[name](spark, sf).select("operation", "percent").collect())
    assert rows("progress_stream") == rows("progress_fold")
