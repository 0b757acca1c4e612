"""OOXML packages as one table of typed rows, from one reading of every package.

A package is opened once, and a part is unpacked and parsed once while the parts of its package stay
below HELD bytes. Beyond that, small parts (relationships, styles, numbering, workbook, slides) are read
as trees when they are needed; document bodies, sheets and shared strings, which have no bound, are
pulled element by element and let go, after a check that the part is well formed. Rows leave in batches
of one kind and bounded size and are written to the shared folder by kind, so that every reader scans
its own kind and columns.

Only what lies next to each other in a package is put together here: relationship targets, columns of
spanning cells, order. Styles, numbering, shared strings and extents are joined by Spark
(``operators.ooxml_facts``).
"""
import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"

# What the columns of each kind of row mean; ``kind_of`` gives them these names.
KINDS = {
    "p": "n style outline num_id ilvl", "tbl": "n tbl n_rows columns", "tc": "n tbl row column span", "link": "n rel_id anchor target", "image": "n rel_id target",
    "style": "style name outline num_id based_on", "level": "pos num_id style ilvl", "slide": "slide shape para level bullet placeholder",
    "sheet": "tbl sheet_no n_rows sheet", "cell": "tbl sheet_no row_no row_at cell_no number_format_id ref type raw inline sheet formula strings", "shared": "",
}
INTS = set("n tbl n_rows columns row column span pos slide shape para level sheet_no row_no row_at cell_no number_format_id".split())
FLAGS = {"bullet", "formula", "strings"}
NUMBERS, STRINGS, TRUTHS = (max(sum(wanted(c) for c in v.split()) for v in KINDS.values()) for wanted in (
    INTS.__contains__, lambda c: c not in INTS | FLAGS, FLAGS.__contains__))
SCHEMA = "path string, part string, node string, ord bigint, text string, error_code string, " + ", ".join(
    [f"i{k} int" for k in range(NUMBERS)] + [f"s{k} string" for k in range(STRINGS)] + [f"b{k} boolean" for k in range(TRUTHS)])
BATCH = 16_384
HELD = 8 << 20           # bytes of parts whose trees one package holds at most
BLANK = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*")


def _places(kind: str) -> dict[str, str]:
    """Column of the table for every name of a kind."""
    names = KINDS[kind].split()
    groups = ("i", [c for c in names if c in INTS]), ("s", [c for c in names if c not in INTS | FLAGS]), ("b", [c for c in names if c in FLAGS])
    return {c: f"{prefix}{k}" for prefix, group in groups for k, c in enumerate(group)}


PLACES = {kind: _places(kind) for kind in KINDS}
NAMES = {kind: v.split() for kind, v in KINDS.items()}


def kind_of(parts: DataFrame, *kinds: str) -> DataFrame:
    """Rows of some kinds with named columns; several kinds share the names they have in common."""
    def named(name: str) -> Column:
        found = None
        for k in kinds:
            if name in PLACES[k]:
                own = F.col(PLACES[k][name])
                found = F.when(F.col("node") == k, own) if found is None else found.when(F.col("node") == k, own)
        return found.alias(name)

    names = list(dict.fromkeys(c for k in kinds for c in KINDS[k].split()))
    return parts.filter(F.col("node").isin(*kinds)).select("path", "part", "node", "ord", "text", *[named(c) for c in names])


def _int(value, default=None):
    """An integer attribute; one that is none counts as absent."""
    try:
        n = int(value)
        return n if abs(n) < 1 << 31 else default
    except (TypeError, ValueError):
        return default


class Package:
    """Rows of one package: the kind, then path, part, order, text, error and the values of that kind."""

    def __init__(self, path: str, z: zipfile.ZipFile):
        self.path, self.zip, self.names, self.trees = path, z, set(z.namelist()), {}

    def row(self, part, node, ord=None, text=None, **values):
        return node, (self.path, part, ord, text, None, *map(values.get, NAMES[node]))

    def tree(self, part):
        """Root of a small part; None if there is none or it is broken, which its own row says."""
        if part in self.trees:
            return self.trees[part]
        try:
            return ET.fromstring(self.zip.read(part)) if part in self.names else None
        except (ET.ParseError, ValueError, LookupError):
            return None

    def pulled(self, part, tag, level):
        """Elements of one level of a part that is known to be well formed, each with the root."""
        if part in self.trees:
            root = self.trees[part]
            for parent in [root] if level == 2 else root:
                yield from ((root, node) for node in parent if node.tag in tag)
            return
        depth, above = 0, []
        with self.zip.open(part) as f:
            for event, node in ET.iterparse(f, ("start", "end")):
                if event == "start":
                    depth += 1
                    if depth < level:
                        above[depth - 1:] = [node]
                    continue
                if depth == level:
                    if node.tag in tag:
                        yield above[0], node
                    above[depth - 2].remove(node)
                depth -= 1

    def check(self):
        """One row per part, with the error of a broken one; returns the names of the whole ones."""
        self.whole, room = set(), HELD
        for part in sorted(self.names):
            if not part.endswith((".xml", ".rels")):
                continue
            error = None
            size = self.zip.getinfo(part).file_size
            if size <= room:
                self.trees[part] = self.tree(part)
                if self.trees[part] is None:
                    del self.trees[part]
                else:
                    room -= size
            try:
                if part not in self.trees:
                    with self.zip.open(part) as f:
                        expat.ParserCreate().ParseFile(f)
                self.whole.add(part)
            except (expat.ExpatError, ValueError, LookupError):
                error = "source_invalid"
            yield "part", (self.path, part, None, None, error)

    def targets(self, part, folder) -> dict[str, str]:
        root = self.tree(part) if part in self.whole else None
        return {} if root is None else {r.get("Id"): r.get("Target") if folder is None else folder + re.sub(f"^/?({folder})?", "", r.get("Target") or "") for r in root.iter(REL + "Relationship")}

    def rows(self):
        yield from self.check()
        yield from self.word()
        yield from self.slides()
        yield from self.sheets()

    # Word.
    def word(self):
        part = "word/document.xml"
        if part in self.whole:
            yield from self.body(part, self.targets("word/_rels/document.xml.rels", None))
        if "word/styles.xml" in self.whole:
            for s in self.tree("word/styles.xml").iter(W + "style"):
                p = s.find(W + "pPr")
                yield self.row("word/styles.xml", "style", style=s.get(W + "styleId"), name=_val(s, "name"), outline=_val(p, "outlineLvl"), num_id=_val(p, "numPr", "numId"), based_on=_val(s, "basedOn"))
        if "word/numbering.xml" in self.whole:
            root = self.tree("word/numbering.xml")
            abstract = {a.get(W + "abstractNumId"): [(_val(v, "pStyle"), v.get(W + "ilvl")) for v in a.findall(W + "lvl")] for a in root.iter(W + "abstractNum")}
            for n in root.iter(W + "num"):
                for pos, (style, ilvl) in enumerate(abstract.get(_val(n, "abstractNumId"), [])):
                    if style and ilvl is not None:
                        yield self.row("word/numbering.xml", "level", pos=pos, num_id=n.get(W + "numId"), style=style, ilvl=ilvl)

    def body(self, part, targets):
        seen, at = dict.fromkeys(("p", "tbl", "tc", "link", "image"), 0), 0

        def made(node, text=None, **values):
            nonlocal at
            seen[node] += 1
            at += 1
            return self.row(part, node, at - 1, text, n=seen[node], **values)

        def references(node):
            for h in node.iter(W + "hyperlink"):
                yield made("link", _word_text(h), rel_id=h.get(R + "id"), anchor=h.get(W + "anchor"), target=targets.get(h.get(R + "id")))
            for b in node.iter(A + "blip"):
                yield made("image", rel_id=b.get(R + "embed"), target=targets.get(b.get(R + "embed")))

        for root, child in self.pulled(part, (W + "p", W + "tbl"), 3):
            if root.find(W + "body") is None:
                continue
            if child.tag == W + "p":
                p = child.find(W + "pPr")
                yield made("p", _word_text(child), style=_val(p, "pStyle"), outline=_val(p, "outlineLvl"), num_id=_val(p, "numPr", "numId"), ilvl=_val(p, "numPr", "ilvl"))
                yield from references(child)
                continue
            grid = child.find(W + "tblGrid")
            cells, width = [], 0
            for r, tr in enumerate(child.findall(W + "tr")):
                column = 0
                for tc in tr.findall(W + "tc"):
                    span = max(1, _int(_val(tc.find(W + "tcPr"), "gridSpan"), 1))
                    cells.append((r, column, span, tc))
                    column += span
                width = max(width, column)
            gridded = 0 if grid is None else len(grid.findall(W + "gridCol"))
            tbl = seen["tbl"] + 1
            yield made("tbl", tbl=tbl, n_rows=len(child.findall(W + "tr")), columns=gridded or width)
            for r, column, span, tc in cells:
                yield made("tc", _word_text(tc), tbl=tbl, row=r, column=column, span=span)
                yield from references(tc)

    # Slides, in the order of the presentation.
    def slides(self):
        if "ppt/presentation.xml" not in self.whole:
            return
        targets, at = self.targets("ppt/_rels/presentation.xml.rels", "ppt/"), 0
        for number, s in enumerate(self.tree("ppt/presentation.xml").iter(P + "sldId"), 1):
            part = targets.get(s.get(R + "id"))
            if part not in self.whole:
                continue
            tree = self.tree(part).find(f"{P}cSld/{P}spTree")
            for i, shape in enumerate([] if tree is None else tree.findall(P + "sp"), 1):
                ph = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                for j, p in enumerate(shape.findall(f"{P}txBody/{A}p"), 1):
                    text = "".join(n.text or "" if n.tag == A + "t" else "\n" for n in p.iter() if n.tag in (A + "t", A + "br"))
                    if BLANK.fullmatch(text):
                        continue
                    ppr = p.find(A + "pPr")
                    bullet = ppr is not None and (ppr.find(A + "buChar") is not None or ppr.find(A + "buAutoNum") is not None)
                    yield self.row(part, "slide", at, text, slide=number, shape=i, para=j, placeholder=None if ph is None else ph.get("type"), bullet=bullet,
                                   level=0 if ppr is None else _int(ppr.get("lvl"), 0))
                    at += 1

    # Sheets, in the order of the workbook; a sheet without rows has no table.
    def sheets(self):
        if "xl/workbook.xml" not in self.whole:
            return
        targets, at, tbl = self.targets("xl/_rels/workbook.xml.rels", "xl/"), 0, 0
        formats = []
        if "xl/styles.xml" in self.whole:
            xfs = self.tree("xl/styles.xml").find(S + "cellXfs")
            formats = [_int(x.get("numFmtId")) for x in ([] if xfs is None else xfs.findall(S + "xf"))]
        strings = False
        if "xl/sharedStrings.xml" in self.whole:
            for k, (_, si) in enumerate(self.pulled("xl/sharedStrings.xml", (S + "si",), 2)):
                strings = True
                yield self.row("xl/sharedStrings.xml", "shared", k, "".join(si.itertext()))
        for number, s in enumerate(self.tree("xl/workbook.xml").iter(S + "sheet"), 1):
            part, name, count = targets.get(s.get(R + "id")), s.get("name"), 0
            if part not in self.whole:
                continue
            for _, r in self.pulled(part, (S + "row",), 3):
                if not count:
                    tbl, table_at, at = tbl + 1, at, at + 1
                row_at = _int(r.get("r"))
                for j, c in enumerate(r.findall(S + "c")):          # values in the order of KINDS
                    v, inline, style = c.find(S + "v"), c.find(S + "is"), _int(c.get("s"), -1)
                    yield "cell", (self.path, part, at, None, None, tbl, number, count, row_at, j, formats[style] if 0 <= style < len(formats) else None, c.get("r"), c.get("t"),
                                   (v.text or "") if v is not None else "".join(c.itertext()), None if inline is None else "".join(inline.itertext()),
                                   name, c.find(S + "f") is not None, strings)
                    at += 1
                count += 1
            if count:
                yield self.row(part, "sheet", table_at, tbl=tbl, sheet_no=number, n_rows=count, sheet=name)


def _val(node, *path):
    for tag in path:
        node = None if node is None else node.find(W + tag)
    return None if node is None else node.get(W + "val")


def _word_text(node):
    # Tab stops inside paragraph properties share the tag of tab characters.
    skip = {id(t) for ppr in node.iter(W + "pPr") for t in ppr.iter(W + "tab")}
    out = []
    for n in node.iter():
        if n.tag == W + "t":
            out.append(n.text or "")
        elif n.tag in (W + "br", W + "cr"):
            out.append("\n")
        elif n.tag == W + "tab" and id(n) not in skip:
            out.append("\t")
    return "".join(out)


def _read(batches):
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    types = dict(zip(names, ({"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.strip().split(" ")[1]] for c in SCHEMA.split(","))))

    def batch(kind, rows):
        held = ["path", "part", "ord", "text", "error_code", *(PLACES[kind][c] for c in NAMES[kind])] if kind in NAMES else ["path", "part", "ord", "text", "error_code"]
        columns = {name: pa.array(values, types[name]) for name, values in zip(held, zip(*rows))} | {"node": pa.repeat(kind, len(rows))}
        return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(len(rows), types[n]) for n in names], names=names)

    kept = {}
    for packages in batches:
        for k in range(packages.num_rows):                  # one package in memory at a time
            path, content = (packages.column(c)[k].as_py() for c in (0, 1))
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for kind, row in Package(path, z).rows():
                        rows = kept.setdefault(kind, [])
                        rows.append(row)
                        if len(rows) >= BATCH:
                            yield batch(kind, kept.pop(kind))
            except (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError, TypeError, EOFError):
                kept.setdefault("part", []).append((path, None, None, None, "source_invalid"))
    for kind, rows in kept.items():
        yield batch(kind, rows)


def ooxml_parts(packages: DataFrame) -> DataFrame:
    """All rows of ``packages(path, content)``, read once and kept in the shared folder by kind.

    Rows of kind ``part`` list the XML parts; broken parts and unreadable packages have an error there.
    """
    spark = packages.sparkSession
    path = scratch(spark)
    packages.select("path", "content").mapInArrow(_read, SCHEMA).write.partitionBy("node").parquet(path)
    schema = SCHEMA.replace(" node string,", "") + ", node string"
    return spark.read.schema(schema).parquet(path)


def source_status(parts: DataFrame) -> DataFrame:
    """One row per package: whether it can be evaluated, and the parts that can't be read."""
    bad = F.col("error_code").isNotNull()
    rows = parts.filter("node = 'part'").groupBy("path").agg(F.count_if(bad).alias("broken"), F.min(F.when(bad, F.coalesce("part", F.lit("package")))).alias("first_broken"))
    return rows.select("path", F.when(F.col("broken") > 0, "NOT_EVALUATED_SOURCE_INVALID").otherwise("EVALUATED").alias("status"), "broken", "first_broken")
