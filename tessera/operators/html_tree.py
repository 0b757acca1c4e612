"""The element tree of a page, from its stream of tags.

The tree rules of the HTML standard as one automaton over tag names: a stack of open elements, implied
ends, scopes, table contexts with foster parenting, and active formatting elements with their
reconstruction and adoption. Texts and attributes stay in the JVM; only names go through, in Arrow
batches, and what comes back is one row per text run or element that can become a fact.

Lists of stack positions by tag, scope and category make every look-up constant, so a page costs time
in proportion to its tags however deep it nests. Head, body and html elements are not built; select,
frames, foreign content and raw text other than script, style and template follow the general rules.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import html
from ..functions.text import NOT_WS

# --- fixed values: categories of the HTML standard -----------------------------------------------
VOID = set("area br embed img input keygen wbr hr param source track base link meta bgsound basefont frame col".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup main menu nav ol p pre listing search section summary ul xmp plaintext hr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = CLOSES_P | HEADINGS | VOID | set("applet button caption colgroup dd dt iframe li marquee noembed noscript object select table tbody td template textarea tfoot th thead title tr".split()) - {"hr"}
SCOPE = set("applet caption table td th marquee object template".split())
IMPLIED = set("dd dt li optgroup option p rb rp rt rtc".split())
BODIES, CELLS, MARKED = {"tbody", "thead", "tfoot"}, {"td", "th"}, {"applet", "marquee", "object"}
TABLE_PARTS = BODIES | CELLS | {"caption", "colgroup", "col", "tr"}
CONTEXT = BODIES | CELLS | {"table", "tr", "caption"}
BLOCK_ENDS = CLOSES_P - {"p", "hr"} | {"button"}

FACT = set("p a li table td th img".split()) | HEADINGS
NODES = "array<struct<id:int,tok:int,tag:string,owners:array<int>,level:int,inside:int,tbl:int,row:int,col:int,n_rows:int,n_cols:int>>"


class Node:
    __slots__ = ("tag", "tok", "kids", "parent", "open")

    def __init__(self, tag, tok):
        self.tag, self.tok, self.kids, self.parent, self.open = tag, tok, [], None, False


class Tree:
    def __init__(self, tokens):
        self.root = Node("", -1)
        self.stack, self.active = [self.root], []
        self.at, self.scope, self.special, self.context = {}, [0], [0], [0]
        self.quirks = True
        for k, t in enumerate(tokens):
            if t[0] == "<":
                (self.end if t[1] == "/" else self.start)(t[2:] if t[1] == "/" else t[1:], k)
            elif t == "!d":
                self.quirks = self.quirks and bool(self.at)
            else:
                self.text(t, k)

    # The stack and its indexes.
    def push(self, node):
        k = len(self.stack)
        self.stack.append(node)
        node.open = True
        self.at.setdefault(node.tag, []).append(k)
        for where, names in ((self.scope, SCOPE), (self.special, SPECIAL), (self.context, CONTEXT)):
            if node.tag in names:
                where.append(k)

    def pop(self):
        node = self.stack.pop()
        node.open = False
        self.at[node.tag].pop()
        for where in (self.scope, self.special, self.context):
            if where[-1] == len(self.stack):
                where.pop()
        return node

    def pop_to(self, k):
        while len(self.stack) > k:
            self.pop()

    def place(self, tag):
        places = self.at.get(tag)
        return places[-1] if places else -1

    def in_scope(self, tag, *more):
        return self.place(tag) > max([self.scope[-1], *(self.place(m) for m in more)])

    def in_table(self, tag):
        return self.place(tag) > self.place("table") if tag != "table" else self.place(tag) > 0

    def implied(self, but=None):
        while self.stack[-1].tag in IMPLIED and self.stack[-1].tag != but:
            self.pop()

    def close_p(self):
        if self.in_scope("p", "button"):
            self.pop_to(self.place("p"))

    # Insertion; inside a table's own structure content goes in front of the table.
    def insert(self, node, foster=True):
        parent, before = self.stack[-1], None
        if foster and parent.tag in BODIES | {"table", "tr"}:
            k = self.place("table")
            table = self.stack[k]
            parent, before = (table.parent, table) if table.parent is not None else (self.stack[k - 1], None)
        self.attach(node, parent, before)

    def attach(self, node, parent, before=None):
        node.parent = parent
        if before is None:
            parent.kids.append(node)
        else:
            k = len(parent.kids) - 1
            while parent.kids[k] is not before:
                k -= 1
            parent.kids.insert(k, node)

    def element(self, tag, tok, foster=True):
        node = Node(tag, tok)
        self.insert(node, foster)
        if tag not in VOID:
            self.push(node)
        return node

    def text(self, t, tok):
        """Texts, comments ("!") and scripts ("$"); only texts that are not blank count as content."""
        if t == "#":
            self.reconstruct()
        self.insert(Node("#" if t == " " else t, tok), foster=t == "#")

    # Active formatting elements; None is a marker.
    def reconstruct(self):
        if not self.active or self.active[-1] is None or self.active[-1].open:
            return
        k = len(self.active)
        while k and self.active[k - 1] is not None and not self.active[k - 1].open:
            k -= 1
        for i in range(k, len(self.active)):
            self.active[i] = self.element(self.active[i].tag, self.active[i].tok)

    def remember(self, node):
        same = 0
        for k in range(len(self.active) - 1, -1, -1):
            if self.active[k] is None:
                break
            same += self.active[k].tag == node.tag
            if same == 3:
                del self.active[k]
                break
        self.active.append(node)

    def to_marker(self):
        while self.active and self.active.pop() is not None:
            pass

    def formatting(self, tag):
        for k in range(len(self.active) - 1, -1, -1):
            if self.active[k] is None:
                return -1
            if self.active[k].tag == tag:
                return k
        return -1

    def adopt(self, tag):
        """End of a formatting element; what it holds across block ends is copied into the blocks."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            self.pop()
            return
        for _ in range(8):
            f = self.formatting(tag)
            if f < 0:
                return self.other_end(tag)
            subject = self.active[f]
            if not subject.open:
                del self.active[f]
                return
            s = self.stack.index(subject)
            if s <= self.scope[-1]:
                return
            block = next((k for k in range(s + 1, len(self.stack)) if self.stack[k].tag in SPECIAL), None)
            if block is None:
                self.pop_to(s)
                del self.active[f]
                return
            above, furthest = self.stack[s - 1], self.stack[block]
            tail = self.stack[block + 1:]
            last, mark, kept = furthest, f, []
            for n, node in enumerate(reversed(self.stack[s + 1:block])):
                if node not in self.active:
                    continue
                k = self.active.index(node)
                if n >= 3:
                    del self.active[k]
                    mark -= k < mark
                    continue
                copy = Node(node.tag, node.tok)
                self.active[k] = copy
                mark = k + 1 if last is furthest else mark
                last.parent.kids.remove(last)
                self.attach(last, copy)
                last = copy
                kept.append(copy)
            last.parent.kids.remove(last)
            if above.tag in BODIES | {"table", "tr"}:
                self.pop_to(s)
                self.insert(last)
            else:
                self.attach(last, above)
            copy = Node(subject.tag, subject.tok)
            copy.kids, furthest.kids = furthest.kids, []
            for kid in copy.kids:
                kid.parent = copy
            self.attach(copy, furthest)
            f = self.active.index(subject)
            del self.active[f]
            self.active.insert(mark - (f < mark), copy)
            self.pop_to(s)
            for node in [*reversed(kept), furthest, copy, *tail]:
                self.push(node)

    def other_end(self, tag):
        if self.place(tag) > self.special[-1]:
            k = self.place(tag)
            self.implied(tag)
            self.pop_to(k)

    # Tags.
    def mode(self):
        return self.stack[self.context[-1]].tag if self.context[-1] else ""

    def table_start(self, tag, tok):
        """A start tag that table structure takes; false if it is content."""
        mode = self.mode()
        if mode in CELLS or mode == "caption":
            if tag not in TABLE_PARTS:
                return False
            self.close_cell()
            return self.table_start(tag, tok)
        if tag == "table":
            self.pop_to(self.place("table"))
            self.start(tag, tok)
            return True
        if tag not in TABLE_PARTS:
            return False
        self.pop_to(self.context[-1] + 1)            # back to the structure itself
        if tag in CELLS:
            if mode == "table":
                self.element("tbody", tok, False)
            if mode != "tr":
                self.element("tr", tok, False)
            self.element(tag, tok, False)
            self.active.append(None)
        elif tag == "tr":
            if mode == "tr":
                self.pop()
            elif mode == "table":
                self.element("tbody", tok, False)
            self.element(tag, tok, False)
        else:
            self.pop_to(self.place("table") + 1)
            if tag != "colgroup":
                self.element(tag, tok, False)
            if tag == "caption":
                self.active.append(None)
        return True

    def close_cell(self):
        self.pop_to(self.context[-1])
        self.to_marker()

    def start(self, tag, tok):
        if tag in ("html", "head", "body") or (tag in TABLE_PARTS and not self.mode()):
            return
        if self.mode() and self.table_start(tag, tok):
            return
        if tag == "image":
            tag = "img"
        if tag in CLOSES_P or tag in HEADINGS:
            self.close_p()
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.pop()
        elif tag == "li" or tag in ("dd", "dt"):
            own = ("li",) if tag == "li" else ("dd", "dt")
            for k in reversed(self.special):
                node = self.stack[k].tag
                if node in own:
                    self.pop_to(k)
                if node not in ("address", "div", "p"):
                    break
            self.close_p()
        elif tag == "table":
            if not self.quirks:
                self.close_p()
        elif tag == "button":
            if self.in_scope("button"):
                self.pop_to(self.place("button"))
            self.reconstruct()
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.pop()
            self.reconstruct()
        elif tag in FORMATTING:
            if tag == "a":
                k = self.formatting("a")
                if k >= 0:
                    old = self.active[k]
                    self.adopt("a")
                    if old in self.active:
                        self.active.remove(old)
                    if old.open:
                        self.pop_to(self.stack.index(old))
            self.reconstruct()
            self.remember(self.element(tag, tok))
            return
        elif tag not in ("param", "source", "track"):
            self.reconstruct()
        self.element(tag, tok)
        if tag in MARKED:
            self.active.append(None)

    def end(self, tag, tok):
        mode = self.mode()
        if tag in ("html", "head", "body", "col", "colgroup"):
            return
        if tag in CONTEXT:
            if not mode or not self.in_table(tag):
                return
            if mode in CELLS or mode == "caption":
                self.close_cell()
                if tag in CELLS or tag == "caption":
                    return
            self.pop_to(self.place(tag))
        elif tag == "br":
            self.start("br", tok)
        elif tag == "p":
            if not self.in_scope("p", "button"):
                self.element("p", tok)
            self.close_p()
        elif tag == "li":
            if self.in_scope("li", "ol", "ul"):
                self.pop_to(self.place("li"))
        elif tag in ("dd", "dt"):
            if self.in_scope(tag):
                self.pop_to(self.place(tag))
        elif tag in HEADINGS:
            k = max(self.place(h) for h in HEADINGS)
            if k > self.scope[-1]:
                self.pop_to(k)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in MARKED or tag in BLOCK_ENDS:
            k = self.place(tag)
            if k >= 0 and k > (self.scope[-2] if tag in MARKED and self.scope[-1] == k else self.scope[-1]):
                self.pop_to(k)
                if tag in MARKED:
                    self.to_marker()
        else:
            self.other_end(tag)


def rows_of(root) -> list[tuple]:
    """Texts and fact elements in tree order: (id, tok, tag, owners, level, inside, tbl, row, col, n_rows, n_cols).

    ``owners`` of a text are the elements whose text it belongs to: headings, paragraphs and links around
    it, items up to the next list, cells up to the next table. ``inside`` is 2 in a cell, 1 in an item.
    """
    out, cells, runs, n = [], {}, {}, 0
    walk = [(root, (), (), (), 0, 0, None)]          # node, plain, item and cell owners, lists, inside, first text of the run
    while walk:
        node, plain, item, cell, lists, inside, first = walk.pop()
        tag = node.tag
        if tag in ("#", "$"):
            run = runs.setdefault(first, n)
            if plain or item or cell:
                out.append((run, node.tok, None, plain + item + cell, 0, 0, None, None, None, None, None))
            n += 1
            continue
        me, n = n, n + 1
        if tag in FACT:
            tbl, row, col = cells.pop(node, (None, None, None))
            rows = columns = None
            if tag == "table":
                parts = [r for k in node.kids for r in ([k] if k.tag == "tr" else k.kids if k.tag in BODIES else []) if r.tag == "tr"]
                own = [[c for c in r.kids if c.tag in CELLS] for r in parts]
                rows, columns = len(parts), max(map(len, own), default=0)
                cells.update((c, (me, i, j)) for i, r in enumerate(own) for j, c in enumerate(r))
            if tag not in CELLS or tbl is not None:
                out.append((me, node.tok, tag, (), max(lists - 1, 0), inside, tbl, row, col, rows, columns))
        if tag in HEADINGS or tag in ("p", "a"):
            plain += (me,)
        elif tag == "li":
            item, inside = item + (me,), max(inside, 1)
        elif tag in CELLS:
            cell, inside = cell + (me,), 2
        elif tag in ("ul", "ol"):
            item, lists = (), lists + 1
        elif tag == "table":
            cell = ()
        if tag == "template":
            continue
        # Texts side by side are one text: the later ones take the first one's id.
        kids, first = [], None
        for k in node.kids:
            first = (first or k) if k.tag == "#" else None
            kids.append((k, plain, item, cell, lists, inside, k if k.tag == "$" else first))
        walk.extend(reversed(kids))
    return out


def _trees(names: pa.Array) -> pa.Array:
    pages, found = [0], []
    for tokens in names.to_pylist():
        found += rows_of(Tree(tokens or []).root)
        pages.append(len(found))
    columns = list(zip(*found)) or [()] * 11
    sizes = np.fromiter((len(x) for x in columns[3]), np.int32, len(found))
    owners = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array([o for x in columns[3] for o in x], pa.int32()))
    arrays = [owners if k == 3 else pa.array(c, pa.string() if k == 2 else pa.int32()) for k, c in enumerate(columns)]
    names = ["id", "tok", "tag", "owners", "level", "inside", "tbl", "row", "col", "n_rows", "n_cols"]
    return pa.ListArray.from_arrays(pa.array(pages, pa.int32()), pa.StructArray.from_arrays(arrays, names=names))


def page_nodes(page: Column) -> tuple[Column, Column]:
    """A page's tokens, and its texts and fact elements, which name their token by its place."""
    def name(t):
        tag = F.lower(F.regexp_extract(t, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
        return (F.when(t.rlike(r"(?is)^<(script|style)\b.*</"), "$").when(t.rlike(r"(?is)^<template\b.*</template"), "!")
                .when(t.rlike("^<[A-Za-z]"), F.concat(F.lit("<"), tag)).when(t.rlike("^</[A-Za-z]"), F.concat(F.lit("</"), tag))
                .when(t.rlike("(?i)^<!doctype"), "!d").when(t.startswith("<!"), "!").when(t.rlike(NOT_WS), "#").otherwise(" "))

    tokens = F.regexp_extract_all(page, F.lit(html.TAG_STREAM), F.lit(0))
    return tokens, F.arrow_udf(_trees, NODES)(F.transform(tokens, name))
