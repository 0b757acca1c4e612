"""Office packages made from rows of the given tables, so that the package readers run at scale."""
import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

NS = ('xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" '
      'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
      'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
      'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
      'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"')
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def _zip(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return buffer.getvalue()


def word_package(lines: list[str]) -> bytes:
    """First line a styled heading, every third a list item by an inherited style, the rest text.

    Behind the lines stand an outlined paragraph, a table with a spanning cell and a link, and an image.
    """
    style = lambda i: "Heading1" if i == 0 else "Item" if i % 3 == 2 else None
    text = lambda t: f"<w:r><w:t>{escape(t)}</w:t></w:r>"
    paragraph = lambda i, t: f'<w:p><w:pPr><w:pStyle w:val="{style(i)}"/></w:pPr>{text(t)}</w:p>' if style(i) else f"<w:p>{text(t)}</w:p>"
    behind = (f'<w:p><w:pPr><w:outlineLvl w:val="1"/></w:pPr>{text("Outlined")}</w:p>'
              f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p>{text("wide")}</w:p></w:tc><w:tc><w:p><w:hyperlink r:id="r1">{text("go")}</w:hyperlink></w:p></w:tc></w:tr></w:tbl>'
              '<w:p><w:r><w:drawing><a:blip r:embed="r2"/></w:drawing></w:r></w:p>')
    return _zip({
        "word/document.xml": f"<w:document {NS}><w:body>{''.join(paragraph(i, t) for i, t in enumerate(lines))}{behind}</w:body></w:document>",
        "word/_rels/document.xml.rels": RELS.format('<Relationship Id="r1" Target="https://example.org/go"/><Relationship Id="r2" Target="media/image1.png"/>'),
        "word/styles.xml": f'<w:styles {NS}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Item"><w:basedOn w:val="List"/></w:style>'
                           '<w:style w:styleId="List"><w:pPr><w:numPr><w:numId w:val="4"/></w:numPr></w:pPr></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {NS}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="1"><w:pStyle w:val="List"/></w:lvl></w:abstractNum>'
                              '<w:num w:numId="4"><w:abstractNumId w:val="1"/></w:num></w:numbering>'})


def slide_package(lines: list[str]) -> bytes:
    """One slide per line: its first word is the title, the line a bullet."""
    paragraph = lambda t, ppr="": f"<a:p>{ppr}<a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
    shape = lambda body, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>"
    parts = {"ppt/presentation.xml": f"<p:presentation {NS}><p:sldIdLst>{''.join(f'<p:sldId r:id={chr(34)}r{i}{chr(34)}/>' for i in range(len(lines)))}</p:sldIdLst></p:presentation>",
             "ppt/_rels/presentation.xml.rels": RELS.format("".join(f'<Relationship Id="r{i}" Target="slides/slide{i}.xml"/>' for i in range(len(lines))))}
    for i, t in enumerate(lines):
        parts[f"ppt/slides/slide{i}.xml"] = (f"<p:sld {NS}><p:cSld><p:spTree>" + shape(paragraph(t.split(" ")[0]), '<p:ph type="title"/>')
                                             + shape(paragraph(t, '<a:pPr lvl="1"><a:buChar char="-"/></a:pPr>')) + "</p:spTree></p:cSld></p:sld>")
    return _zip(parts)


def sheet_package(lines: list[str]) -> bytes:
    """A row per line: its number, a shared string, its length as a formatted number.

    The first row goes on with a formula, a boolean, an error, an inline string and a general decimal.
    """
    more = '<c r="D1"><f>1+1</f><v>2</v></c><c r="E1" t="b"><v>1</v></c><c r="F1" t="e"><v>#N/A</v></c><c r="G1" t="inlineStr"><is><t>in</t></is></c><c r="H1"><v>0.5</v></c>'
    row = lambda i, t: (f'<row r="{i + 1}"><c r="A{i + 1}"><v>{i}</v></c><c r="B{i + 1}" t="s"><v>{i}</v></c><c r="C{i + 1}" s="1"><v>{len(t)}</v></c>{more if i == 0 else ""}</row>')
    return _zip({
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="Lines" r:id="x"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="x" Target="worksheets/sheet1.xml"/>'),
        "xl/worksheets/sheet1.xml": f"<worksheet {NS}><sheetData>{''.join(row(i, t) for i, t in enumerate(lines))}</sheetData></worksheet>",
        "xl/sharedStrings.xml": f"<sst {NS}>{''.join(f'<si><t>{escape(t)}</t></si>' for t in lines)}</sst>",
        "xl/styles.xml": f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="2"/></cellXfs></styleSheet>'})


def packages(rows: DataFrame, build) -> DataFrame:
    """``(path, content)`` of a package per row of ``rows(path, text)``."""
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [build(t.split("\n")) for t in batch["text"]]})
    return rows.select("path", "text").mapInPandas(run, "path string, content binary")
