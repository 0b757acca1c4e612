"""Blocks of Markdown texts, in Arrow batches: lines, fences, lists with levels, tables, definitions.

A document is one string cell. One pass over its lines carries what is open (a fence, raw HTML, a table, a
list), so its cost and memory grow with the text alone. Patterns read as Java reads them: classes are those of
ASCII, and ``.`` and the end of a line know Java's line terminators.
"""
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.inlines import inlines, java, key_of, keys_of, unescape
from ..functions.text import WS_CHARS

# --- fixed values: tags that start a raw HTML block --------------------------------------------
HTML_BLOCK_TAGS = ("address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|"
                   "dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|"
                   "frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|"
                   "noframes|ol|optgroup|option|p|param|pre|script|search|section|style|summary|table|"
                   "tbody|td|textarea|tfoot|th|thead|title|tr|track|ul")
HTML_START = rf"(?i)^ {{0,3}}(?:<!--|</?(?:{HTML_BLOCK_TAGS})(?:\s|/?>|$)|<(?:/?[a-z][a-z0-9\-]*)[^<>]*>\s*$)"
FENCE = r"^\s*(?:`{3,}[^`]*|~{3,}.*)$"
ATX = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$"
RULE = r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$"
UNDERLINE = r"^ {0,3}(?:=+|-+)[ \t]*$"
ITEM = r"^([ \t]*)([\-+*]|[0-9]{1,9}[.)])(?:([ \t]+)(.*)|[ \t]*)$"
DELIMITER = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
QUOTE = r"^(?: {0,3}> ?)+"

#: ``nth`` numbers a fact among those of its kind, a cell's is that of its table; rows and columns are the table's.
FACT = ("struct<start:int,col:int,kind:string,ord:bigint,nth:int,text:binary,target:binary,title:binary,"
        "tbl:int,level:int,ordered:boolean,heading_level:int,n_rows:int,n_cols:int>")
#: A text is an array of blocks, a list or a table is one; a block of items or rows; these of pieces, the cells of a row; a piece
#: of facts: itself and the links and images in it.
BLOCKS = f"array<array<array<array<{FACT}>>>>"

_HTML, _FENCE, _ATX, _RULE, _UNDER, _ITEM, _DELIMITER, _QUOTE = map(java, (HTML_START, FENCE, ATX, RULE, UNDERLINE, ITEM, DELIMITER, QUOTE))
_DEFINITION, _TITLE, _NAMED = map(java, (md.DEFINITION, md.TITLE_LINE, r"^ {0,3}\[[^\]]*[^\]\s]"))
_POINTED, _EDGE, _BAR = java(r"^<(.*)>$"), java(r"^\||(?<!\\)\|$"), java(r"(?<!\\)\|")
_RUN, _ONE_RUN = java("^(`+|~+)"), java("^(`+|~+)$")
_PLAIN = (False, 0, False, False, False, False, False, False, False, False)


def _looks(line: str) -> tuple:
    """Blank, indent, and whether a line looks deep, like a heading, rule, underline, item, delimiter row, row or raw HTML."""
    body = line.lstrip(" \t")
    mark, piped = body[:1], "|" in line
    if not piped and mark not in "#-*_=+0123456789:<" and len(body) == len(line) and mark not in WS_CHARS:
        return _PLAIN
    return (not line.strip(WS_CHARS), len(line) - len(body), line.startswith("    "), mark == "#" and bool(_ATX.search(line)),
            mark != "" and mark in "-*_" and bool(_RULE.search(line)), mark != "" and mark in "=-" and bool(_UNDER.search(line)),
            mark != "" and mark in "-+*0123456789" and bool(_ITEM.search(line)),
            mark != "" and mark in "|:-" and bool(_DELIMITER.search(line)), piped, mark == "<" and bool(_HTML.search(line)))


def _fences(lines: list[str]) -> list[bool]:
    """Whether a line opens or closes a code block."""
    if not any(map(_FENCE.search, lines)):
        return [False] * len(lines)
    out, opened = [], ""
    for line in lines:
        t, fence = line.strip(" "), False
        if _FENCE.search(t):
            run = _RUN.search(t)
            run = run[1] if run else ""
            if opened == "":
                opened, fence = run, True
            elif _ONE_RUN.search(t) and run.startswith(opened):
                opened, fence = "", True
        out.append(fence)
    return out


def _lines(texts: list[tuple[str, bool]]) -> tuple:
    """Numbers and texts of lines, which of them are code (or none), and which may define labels (or none).

    Texts of one key are one document: their lines are read together, by number.
    """
    nos, lines, fences, may = [], [], [], []
    for text, defines in texts:
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        own = text.split("\n")
        fences += _fences(own) if "```" in text or "~~~" in text else [False] * len(own)
        lines += [_QUOTE.sub("", t) if ">" in t else t for t in own] if ">" in text else own
        nos += range(len(own))
        may += [bool(defines)] * len(own)
    if len(texts) > 1:
        by_no = sorted(range(len(nos)), key=nos.__getitem__)
        nos, lines, fences, may = ([x[i] for i in by_no] for x in (nos, lines, fences, may))
    code = None
    if True in fences:
        inside = [n % 2 == 1 for n in accumulate(fences)]
        code = [a or b for a, b in zip(fences, inside)]
    return nos, lines, code, may if True in may else None


def _definitions(lines: list[str], code: list[bool] | None, may: list[bool]) -> tuple[set[int], dict[int, tuple]]:
    """Places of lines that belong to link reference definitions, and by the place where one begins its key, target and title.

    A definition can't interrupt a paragraph: the last line before its run of definitions that is none
    decides. A title may follow on a line of its own.
    """
    defined, found, untitled, above = set(), {}, False, False
    for i, line in enumerate(lines):
        able = may[i] and not (code and code[i])
        m = able and _NAMED.search(line) and _DEFINITION.search(line) or None
        title = able and untitled and _TITLE.search(line)
        if m or title:
            if not above:
                defined.add(i)
                if m:
                    found[i] = (m[1], m[2], m[3] or "")
            if not m and i - 1 in found:
                found[i - 1] = (*found[i - 1][:2], title[1])
        elif may[i]:
            above = able and bool(line.strip(WS_CHARS)) and not (_ATX.search(line) or _RULE.search(line) or _UNDER.search(line))
        untitled = bool(m) and not m[3]
    return defined, {i: (key_of(label), unescape(_POINTED.sub(r"\1", target)), unescape(title[1:-1])) for i, (label, target, title) in found.items()}


def _groups(texts: list[tuple[str, bool]]) -> list[tuple[int, dict]]:
    """Blocks by the line where they start: their first kind, their text and what their lines say of them."""
    nos, lines, code, may = _lines(texts)
    defined, found = _definitions(lines, code, may) if may else ((), {})
    groups = {}
    html, table, owner, list_no, deep_so_far, first = 0, -1, -1, 0, True, 0
    after_blank, after_plain, after_code, after_text = True, False, False, False
    following, last = _looks(lines[0]), len(lines) - 1
    for i, line in enumerate(lines):
        no = nos[i]
        blank, indent, deep, atx, rule, under, item, delimits, piped, raw_html = following
        following = _looks(lines[i + 1]) if i < last else _PLAIN
        coded = code is not None and code[i]
        if coded:
            kind = "code"
        elif blank:
            kind = "blank"
        elif i in defined:
            kind = "definition"
        elif atx:
            kind = "atx"
        elif under and after_plain:
            kind = "underline"
        elif rule:
            kind = "rule"
        else:
            kind = "plain"
            if item:
                parts = _ITEM.search(line)
                number = parts[2]
                if not (after_plain and (number[0] in "0123456789" and number not in ("1.", "1)") or not parts[4])):
                    kind = "item"
            if kind == "plain" and piped and not delimits and following[7] and following[8]:
                kind = "head"
        # Raw HTML runs to the next blank line; a table to the next line of another kind; a list until
        # text returns to the margin after a break.
        if kind == "blank":
            html, deep_so_far = 0, True
        else:
            if raw_html and not coded:
                html = 1
            if indent < 4:
                deep_so_far = False
        if kind == "head":
            table = no
        elif kind != "plain":
            table = -1
        if kind == "item":
            owner = no
        elif indent < 2 and (kind in ("atx", "rule", "head", "underline", "definition") or kind == "plain" and after_blank or coded and not after_code):
            owner = -1
            list_no += 1
        block = None
        if not (coded or kind == "blank" or html or deep_so_far and owner < 0 and kind != "item" or kind == "rule"):
            if kind == "definition":
                block = "definition" if i in found else None
            elif kind == "atx":
                block = "heading"
            elif table >= 0 and no == table + 1:
                block = None
            elif kind == "head" or table >= 0 and kind == "plain":
                block = "row"
            elif kind == "item" or owner >= 0:
                block = "item"
            elif kind == "underline":
                block = "underline"
            else:
                block = "text"
        # A paragraph starts where the line before is not part of one; rows and headings stand alone.
        if block is not None:
            if block == "text":
                if not after_text:
                    first = no
                start = first
            else:
                start = owner if block == "item" else nos[i - 1] if block == "underline" else no
            group = groups.get(start)
            if group is None:
                group = groups[start] = {"block": block, "texts": []}
            elif block < group["block"]:
                group["block"] = block
            most = lambda name, value: group.update({name: max(value, group.get(name, value))})
            if block == "heading":
                m = _ATX.search(line)
                most("heading_level", len(m[1]))
                group["texts"].append((no, (m[2] or "").strip(" ")))
            elif kind == "item":
                most("indent", indent)
                most("content", len(parts[1]) + len(parts[2]) + (len(parts[3]) if parts[3] and len(parts[3]) < 5 else 1))
                most("list_no", list_no)
                most("ordered", number[0] in "0123456789")
                group["texts"].append((no, (parts[4] or "").strip(" ")))
            elif block == "underline":
                most("setext", 1 if "=" in line else 2)
            elif block == "definition":
                most("definition", found[i])
            else:
                group["texts"].append((no, line.strip(" ")))
                if block == "row":
                    most("table", table)
        after_text = block == "text"
        after_blank, after_code = blank, coded
        after_plain = not (blank or deep or atx or rule or item or kind == "definition")
    return sorted(groups.items())


def facts_of(texts: list[tuple[str, bool]]) -> list[list[list[list[list]]]]:
    """``BLOCKS`` of the texts of one key, facts as lists of the fields of ``FACT``.

    Of several definitions of one label the first wins, wherever it stands; a piece sees those that it names.
    """
    if not texts:
        return []
    groups = _groups(texts)
    known = {}
    for _, g in groups:
        if "definition" in g:
            known.setdefault(g["definition"][0], g["definition"][1:])
    blocks, at, order = [], None, 0
    count = dict.fromkeys(("HEADING", "TEXT_BLOCK", "LIST_ITEM", "TABLE", "LINK", "IMAGE"), 0)
    stacks, held = {}, []             # open items of each list by the indent of their content; cells since the last table began

    def piece(start, col, kind, raw, table=None, level=None, ordered=None, heading=None):
        nonlocal order
        if kind == "TABLE_CELL":
            nth = count["TABLE"]
        else:
            nth = count[kind] = count[kind] + 1
        text, refs = None, ()
        if raw is not None:
            named = {k: known[k] for k in keys_of(raw) if k in known} if known and "[" in raw else None
            text, refs = inlines(raw, named)
        facts = [[start, col, kind, order, nth, text, None, None, table, level, ordered, heading, None, None]]
        for of, shown, target, title in refs:
            order += 1
            count[of] += 1
            facts.append([start, col, of, order, count[of], shown, target, title, table, level, ordered, heading, None, None])
        order += 1
        return facts

    def close():
        cells = [c for c in held if c[2] == "TABLE_CELL"]
        if cells:
            rows, columns = max(c[0] - c[8] - (c[0] > c[8]) for c in cells), max(c[1] for c in cells)
            for c in held:
                c[12:14] = rows + 1, columns + 1
        held.clear()

    for start, g in groups:
        block, raw = g["block"], "\n".join([t for _, t in sorted(g["texts"])]).replace("\\\n", "\n")
        if block == "row":
            table, row = g["table"], []
            if start == table:
                close()
                row.append(piece(start, -1, "TABLE", None, table))
            bare = _EDGE.sub("", raw.strip(" "))
            row += [piece(start, i, "TABLE_CELL", c.strip(" ").replace("\\|", "|"), table) for i, c in enumerate(_BAR.split(bare))]
            held += [facts[0] for facts in row]
            kept = ("row", table)
        elif block == "item":
            indent, content, list_no = g.get("indent"), g.get("content"), g.get("list_no")
            outer = [c for c in stacks.get(list_no, ()) if c is not None and indent is not None and c <= indent]
            row = [piece(start, 0, "LIST_ITEM", raw, None, len(outer), g.get("ordered"))]
            stacks[list_no] = [*outer, content]
            kept = ("item", list_no)
        elif block == "heading" or "setext" in g:
            row, kept = [piece(start, 0, "HEADING", raw, heading=g.get("heading_level", g.get("setext")))], None
        elif block == "definition":
            continue
        else:
            row, kept = [piece(start, 0, "TEXT_BLOCK", raw)], None
        if kept is None or kept != at:
            blocks.append([])
        blocks[-1].append(row)
        at = kept
    close()
    return blocks


HELD = 1 << 15          # facts that stay Python objects until they become an Arrow array
_FIELDS = {"start": pa.int32(), "col": pa.int32(), "kind": pa.string(), "ord": pa.int64(), "nth": pa.int32(), "text": pa.binary(), "target": pa.binary(),
           "title": pa.binary(), "tbl": pa.int32(), "level": pa.int32(), "ordered": pa.bool_(), "heading_level": pa.int32(), "n_rows": pa.int32(), "n_cols": pa.int32()}


def _struct(facts: list[list]) -> pa.Array:
    columns = dict(zip(_FIELDS, zip(*facts))) if facts else dict.fromkeys(_FIELDS, ())
    for name in ("text", "target", "title"):
        columns[name] = [None if t is None else t.encode("utf-8", "surrogateescape") for t in columns[name]]
    return pa.StructArray.from_arrays([pa.array(columns[n], t) for n, t in _FIELDS.items()], names=list(_FIELDS))


def _parsed(documents: pa.Array) -> pa.Array:
    ends, arrays, found, done = ([0], [0], [0], [0]), [], [], 0
    for texts in documents:
        for block in facts_of([(x["text"].decode("utf-8", "surrogateescape"), x["defines"]) for x in texts.as_py()]):
            for row in block:
                for piece in row:
                    found += piece
                    ends[3].append(done + len(found))
                ends[2].append(len(ends[3]) - 1)
            ends[1].append(len(ends[2]) - 1)
        ends[0].append(len(ends[1]) - 1)
        if len(found) >= HELD:
            arrays.append(_struct(found))
            done, found = done + len(found), []
    array = pa.concat_arrays([*arrays, _struct(found)])
    for end in reversed(ends):
        array = pa.ListArray.from_arrays(pa.array(end, pa.int32()), array)
    return array


def with_blocks(arms: DataFrame, name: str) -> DataFrame:
    """``(doc_id, arm)`` and ``BLOCKS`` of its texts. Bytes go both ways, so text that is not UTF-8 stays as it is."""
    text = F.col("markdown")
    texts = F.collect_list(F.when(text.isNotNull(), F.struct(text.cast("binary").alias("text"), md.may_define(text).alias("defines"))))
    documents = arms.groupBy("doc_id", "arm").agg(texts.alias(name))
    return documents.select("doc_id", "arm", F.arrow_udf(_parsed, BLOCKS)(name).alias(name))
