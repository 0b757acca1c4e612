"""Main text of web pages by wrapper induction.

Each page is parsed into a tree; siblings of one kind form one iterated slot. Every page of a host
is aligned with the host's pivot page by simple tree matching, and matched nodes are counted over
all pages: how often, how many characters outside links, and how many pages share the same text.
Copies and near copies count once: of pages whose longest varying text is the same, one is counted. A
text that a node hardly ever changes is template, on the pages that have that text there. The main slot is the deepest node that holds most
of the varying text outside noise elements; an ``article`` or ``main`` element is preferred. A
page's text is what stands in the nodes matched with the main slot, without template nodes and
noise; where nothing matches, the page's own largest candidate is used.

Elements nested deeper than DEPTH are aligned as part of their ancestor there, so trees of any depth are
read and nothing in them is lost. Null and empty pages, and pages without text, yield the empty text. A null or odd URL belongs to the
host ''. Repeated rows are extracted one by one; other columns are ignored.
"""
import html as entities
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep

TEMPLATE, PAGES = 0.9, 10            # share of a host's distinct pages with one text, and pages needed, to call that text template
DEPTH = 200                          # levels of a tree that are aligned one by one
MAIN = 0.5                           # share of the varying text that the main slot holds

# HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td
tfoot th thead tr ul""".split())
NOISE = frozenset("""script style noscript template head title nav aside footer form button select option textarea input label iframe object svg
canvas dialog menu audio video noembed noframes xmp""".split())
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu
breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent notice notices alert popup modal overlay comment comments
disqus reply replies discussion share sharing social related recommended newsletter subscribe signup login search pagination pager widget skip""".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("tag", "kind", "noise", "items")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kind, self.noise, self.items = tag, tag, tag in NOISE, []
        if attributes and not attributes.isspace():
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                words = re.split(r"[\s_-]+", value.lower().strip())
                if name == "class" and words[0]:
                    self.kind = f"{tag}.{value.split()[0].lower()}"
                if tag not in ("article", "main", "body", "html"):
                    self.noise = self.noise or name == "hidden" or (name == "role" and words[0] in NOISE_ROLES) or (name in ("class", "id") and not NOISE_WORDS.isdisjoint(words))


def parse(page: str) -> Node:
    """The page's tree: items are texts and nodes; ends that HTML leaves out are put in."""
    root = Node("html")
    stack, at = [root], 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].items.append(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "article", "main", "body") and tag not in BLOCK:
                    break
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            _close(stack, {"p"}, {"table", "td", "th", "li", "article", "section", "div", "main", "body"} if tag != "p" else {"table", "td", "th", "li", "div"})
        if tag in CLOSES:
            _close(stack, CLOSES[tag], FENCES.get(tag, set()))
        attributes = m[3] or m[6] or ""
        node = Node(tag, attributes)
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            node.items.append(page[at:end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].items.append(page[at:])
    return root


def _close(stack: list[Node], tags: set[str], fences: set[str]) -> None:
    """Drop the outermost open element of ``tags`` inside the nearest fence, and all in it."""
    at = None
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            at = k
        elif stack[k].tag in fences:
            break
    if at is not None:
        del stack[at:]


def blocks(nodes: list[Node], skip=lambda node: node.noise):
    """Texts of blocks in page order: references decoded, white space inside a block one space."""
    out, run = [], []

    def flush():
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    for top in nodes:
        todo = [iter(top.items)]
        while todo:
            item = next(todo[-1], None)
            if item is None:
                todo.pop()
                if todo and todo[-1] is END:
                    todo.pop()
                    flush()
            elif isinstance(item, str):
                run.append(item)
            elif item.tag == "br":
                run.append(" ")
            elif skip(item):
                if item.tag in BLOCK:
                    flush()
            else:
                if item.tag in BLOCK:
                    flush()
                    todo.append(END)
                todo.append(iter(item.items))
        flush()
    return out


END = iter(())


# Alignment ---------------------------------------------------------------------------------------

class Slot:
    """All siblings of one kind: their nodes, own text and slots of their children; noise and all in it stays out."""

    __slots__ = ("kind", "nodes", "slots", "deepest")

    def __init__(self, kind: str, nodes: list[Node], depth: int = 1):
        self.kind, self.nodes, self.slots, self.deepest = kind, nodes, [], depth == DEPTH
        if self.deepest:
            return
        groups: dict[str, list[Node]] = {}
        for node in nodes:
            for item in node.items:
                if not isinstance(item, str) and item.tag in BLOCK and not item.noise:
                    groups.setdefault(item.kind, []).append(item)
        self.slots = [Slot(k, v, depth + 1) for k, v in groups.items()]


def outline(slot: Slot) -> list:
    """Kind and children's outlines: what a pivot needs for matching."""
    return [slot.kind, [outline(s) for s in slot.slots]]


def tree_match(slot: Slot, other: list, path: str = "") -> tuple[int, list[tuple[str, Slot]]]:
    """Simple tree matching: size of the largest order-keeping match, and (pivot path, slot) pairs."""
    if slot.kind != other[0]:
        return 0, []
    path = f"{path}/{slot.kind}"
    a, b = slot.slots, other[1]
    lead = 0                                       # equal kinds at the front always match best with each other
    pairs, size = [(path, slot)], 1
    while lead < min(len(a), len(b)) and a[lead].kind == b[lead][0]:
        s, own = tree_match(a[lead], b[lead], path)
        size, pairs, lead = size + s, pairs + own, lead + 1
    a, b = a[lead:], b[lead:]
    if a and b:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        kept: dict[tuple[int, int], list] = {}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1])
                if a[i - 1].kind == b[j - 1][0]:
                    s, own = tree_match(a[i - 1], b[j - 1], path)
                    kept[i, j] = own
                    best[i][j] = max(best[i][j], best[i - 1][j - 1] + s)
        i, j = len(a), len(b)
        size += best[i][j]
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                pairs = pairs + kept[i, j]
                i, j = i - 1, j - 1
    return size, pairs


def own_text(slot: Slot) -> tuple[str, int]:
    """Text of a slot's nodes outside the slots of its children, and its length without links."""
    whole, free = [], 0
    for node in slot.nodes:
        todo = [(item, False) for item in reversed(node.items)]
        while todo:
            item, linked = todo.pop()
            if isinstance(item, str):
                whole.append(item)
                free += 0 if linked else len(item.strip())
            elif not item.noise and (item.tag not in BLOCK or slot.deepest):
                todo.extend((x, linked or item.tag == "a") for x in reversed(item.items))
    return " ".join("".join(whole).split()), free


def text_hash(text: str) -> int:
    from xxhash import xxh64_intdigest
    h = xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def induce(stats: list[dict]) -> dict:
    """Main slot and template paths of a host with the hashes of their texts, from counts of its aligned nodes."""
    constant = {s["path"]: s["t"] for s in stats if s["pages"] >= PAGES and s["top"] >= TEMPLATE * s["pages"]}
    mass: dict[str, int] = {}
    for s in stats:
        if s["path"] not in constant:
            parts = s["path"].split("/")[1:]
            for k in range(1, len(parts) + 1):
                mass["/" + "/".join(parts[:k])] = mass.get("/" + "/".join(parts[:k]), 0) + s["chars"]
    total = max(mass.values(), default=0)
    good = [p for p, m in mass.items() if total and m >= MAIN * total]
    named = [p for p in good if p.rsplit("/", 1)[1].split(".")[0] in ("article", "main")]
    deep = [p for p in good if p.rsplit("/", 1)[1].split(".")[0] in ("body", "div", "section", "td", "html")]
    main = max(named or deep, key=lambda p: p.count("/"), default="")
    return {"main": main, "template": sorted((p, t) for p, t in constant.items() if p.startswith(main + "/"))}


def is_template(slot: Slot, paths: dict[int, str], template: dict[str, int]) -> bool:
    """Whether all text of a slot and of those below it is the host's constant text there."""
    text = own_text(slot)[0]
    return (not text or template.get(paths.get(id(slot))) == text_hash(text)) and all(is_template(s, paths, template) for s in slot.slots)


def own_candidate(root: Node) -> list[Node]:
    """Without a wrapper: articles, or main elements, or the whole page."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in found and not node.noise:
            found[node.tag].append(node)
            continue
        todo.extend(x for x in reversed(node.items) if not isinstance(x, str) and not x.noise)
    return found["article"] or found["main"] or [root]


def extract(page: str, pivot: list | None, wrapper: dict | None) -> str:
    root = parse(page)
    chosen, template = [], set()
    if pivot and wrapper and wrapper["main"]:
        pairs = tree_match(Slot("html", [root]), pivot)[1]
        paths = {id(slot): path for path, slot in pairs}
        for path, slot in pairs:
            if path == wrapper["main"]:
                chosen = slot.nodes
            elif path in wrapper["template"] and is_template(slot, paths, wrapper["template"]):
                template.update(id(n) for n in slot.nodes)
    return "\n".join(blocks(chosen or own_candidate(root), lambda n: n.noise or id(n) in template))


# Spark jobs ------------------------------------------------------------------------------------

@lru_cache(maxsize=256)
def _pivot(text: str) -> list:
    import json
    return json.loads(text)


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pivot, main, template) from rows of page_id, host and html; counts cover all distinct pages."""
    import json

    @F.arrow_udf(T.StringType())
    def outlined(html: pa.Array) -> pa.Array:
        return pa.array([json.dumps(outline(Slot("html", [parse(h or "")]))) for h in html.to_pylist()], pa.string())

    first = pages.groupBy("host").agg(F.min(F.struct(F.xxhash64("html").alias("h"), "page_id")).alias("p")).select("host", "p.h", "p.page_id")
    same = (F.xxhash64("html") == F.col("h")) & F.col("page_id").eqNullSafe(F.col("_page"))
    pivots = keep(pages.join(first.withColumnRenamed("page_id", "_page"), "host").filter(same).dropDuplicates(["host"]).select("host", outlined("html").alias("pivot")))

    def aligned(batches):
        for b in batches:
            out = {"host": [], "page": [], "path": [], "t": [], "size": [], "chars": []}
            for host, page, html, pivot in zip(*(b.column(k).to_pylist() for k in range(4))):
                for path, slot in tree_match(Slot("html", [parse(html)]), _pivot(pivot))[1]:
                    text, free = own_text(slot)
                    for k, v in zip(out, (host, page, path, text_hash(text), len(text), free)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.string() if k in ("host", "path") else pa.int64()) for k in out]))

    rows = pages.join(pivots, "host").select("host", F.xxhash64("html").alias("page"), "html", "pivot")
    found = rows.mapInArrow(aligned, "host string, page bigint, path string, t bigint, size bigint, chars bigint")
    nodes = keep(found.groupBy("host", "page", "path").agg(*(F.min(c).alias(c) for c in ("t", "size", "chars"))))      # equal pages once
    varying = keep(nodes.groupBy("host", "path").agg((F.min("t") != F.max("t")).alias("varies")).filter("varies"))
    longest = F.max(F.when(F.col("varies"), F.struct("size", "path", "t"))).alias("content")
    contents = nodes.join(varying, ["host", "path"], "left").groupBy("host", "page").agg(longest)
    one_each = keep(contents.groupBy("host", "content").agg(F.min("page").alias("page")).select("host", "page"))
    by_text = nodes.join(one_each, ["host", "page"]).groupBy("host", "path", "t", (F.col("size") > 0).alias("some")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    top = F.max(F.when(F.col("some"), F.struct("n", "t")))
    by_node = by_text.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.coalesce(top["n"], F.lit(0)).alias("top"), top["t"].alias("t"), F.sum("chars").alias("chars"))
    per_host = by_node.groupBy("host").agg(F.collect_list(F.struct("path", "pages", "top", "t", "chars")).alias("stats"))     # as many rows as the pivot has nodes

    @F.arrow_udf("struct<main:string,template:array<struct<path:string,t:bigint>>>")
    def induced(stats: pa.Array) -> pa.Array:
        found = [induce(s) for s in stats.to_pylist()]
        rows = [{"main": w["main"], "template": [{"path": p, "t": t} for p, t in w["template"]]} for w in found]
        return pa.array(rows, pa.struct([("main", pa.string()), ("template", pa.list_(pa.struct([("path", pa.string()), ("t", pa.int64())])))]))

    return per_host.select("host", induced("stats").alias("w")).join(pivots, "host").select("host", "pivot", "w.main", "w.template")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) of every page."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    found = keep(wrappers(rows))

    @F.arrow_udf(T.StringType())
    def texts(html: pa.Array, pivot: pa.Array, main: pa.Array, template: pa.Array) -> pa.Array:
        columns = (x.to_pylist() for x in (html, pivot, main, template))
        return pa.array([extract(h, _pivot(p) if p else None, {"main": m or "", "template": {x["path"]: x["t"] for x in t or ()}}) for h, p, m, t in zip(*columns)], pa.string())

    return rows.join(found, "host", "left").select(F.col("page_id").alias(key), F.col("url").alias(url), texts("html", "pivot", "main", "template").alias("text"))
