"""Facts of pages whose tags don't nest, by the tree rules of the HTML standard."""
import pytest

from tessera.operators.facts import html_facts

D = "<!DOCTYPE html>"
P, H, L, A, C = "TEXT_BLOCK", "HEADING", "LIST_ITEM", "LINK", "TABLE_CELL"
T = ("TABLE", None)
PAGES = [
    # formatting across blocks
    ("<b><p>x</b>y</p>z", [(P, "xy")]), ("<p>x<b>y</p><p>z</b>w</p>", [(P, "xy"), (P, "zw")]), ("<b>1<p>2</p>3</b>", [(P, "2")]),
    ("<p><a href=x>one<p>two</a>three", [(P, "one"), (A, "one"), (P, "twothree"), (A, "two")]),
    ("<a href=x>1<div>2</a>3</div>", [(A, "1"), (A, "2")]), ("<a href=1>one<a href=2>two</a>", [(A, "one"), (A, "two")]),
    ("<p>1<i>2<div>3</i>4</div>5", [(P, "12")]), ("<a href=q><p>in<i>k</a>out</i></p>", [(A, ""), (P, "inkout"), (A, "ink")]),
    # implied ends
    ("<h1>a<h2>b</h2>", [(H, "a"), (H, "b")]), ("<ul><li>a<li>b<ol><li>c</ol>d</ul>", [(L, "a"), (L, "b d"), (L, "c")]), ("<li>a</li><li>b", [(L, "a"), (L, "b")]),
    ("<p>1</div>2</p>", [(P, "12")]), ("<div><p>1</div>2", [(P, "1")]), ("<p>a</p></p>b", [(P, "a")]), ("<button><p>a</button>b", [(P, "a")]), ("<dl><dt>a<dd><p>b<dt>c</dl>", [(P, "b")]),
    ("<p>a<ul><li>x<p>y</ul>z", [(P, "a"), (L, "x y")]), ("<div><span><p>a</span>b</div>", [(P, "ab")]), ("<h1>t</h3>u", [(H, "t")]),
    # tables
    (D + "<p>a<table><tr><td>c</table>d", [(P, "a"), T, (C, "c")]), ("<p>a<table><tr><td>c</table>d", [(P, "acd"), T, (C, "c")]),
    ("<ul><li><table>foo<tr><td>bar</td></tr>baz</table></ul>", [(L, "foobaz bar"), T, (C, "bar")]), ("<td>x</td><p>y", [(P, "y")]),
    ("<table><td>1<td>2<tr><td>3</table>", [T, (C, "1"), (C, "2"), (C, "3")]), ("<table><caption>cap<p>pp</caption><tr><td>x</table>", [T, (C, "x"), (P, "pp")]),
    ("<table><tr><td><table><tr><td>in</table>out</table>", [T, (C, "out"), T, (C, "in")]), ("<table><tr><p>front<td>cell</table>", [(P, "front"), T, (C, "cell")]),
    ("<table><tr><td><b>x</table><p>y", [T, (C, "x"), (P, "y")]), ("<table><a href=1>l<tr><td>c</table>m", [(A, "l"), T, (C, "c"), (A, "m")]),
    ("<table><tbody><tr><th>a</tbody></td><tfoot><td>b</table>", [T, (C, "a"), (C, "b")]), ("<table><table><tr><td>x</table>", [T, T, (C, "x")]),
    # texts
    ("<ul><li>x<5 y</ul>", [(L, "x<5 y")]), ("<ul><li>a<!--c-->b</ul>", [(L, "a b")]), ("<p>a<!--c-->b", [(P, "ab")]), ("<p>s<script>1<2</script>t", [(P, "s1<2t")]),
    ("<template><p>no</p></template><p>yes", [(P, "yes")]), ("", []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = html_facts(spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "doc_id bigint, html string")).orderBy("doc_id", "ord").collect()
    got = {i: [] for i in range(len(PAGES))}
    for r in rows:
        got[r.doc_id].append(r)
    return got


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_page(found, k):
    assert [(r.kind, r.text) for r in found[k]] == PAGES[k][1], PAGES[k][0]
    assert [r.ord for r in found[k]] == list(range(len(found[k])))


def test_table_shapes_and_levels(spark):
    rows = html_facts(spark.createDataFrame([(1, "<table><td>1<td>2<tr><td>3</table><ol><li>a<ul><li>b</ol>")], "doc_id bigint, html string")).orderBy("ord").collect()
    assert rows[0].attributes == {"rows": "2", "columns": "2"} and [r.fact_id for r in rows[:4]] == ["table:1", "table:1:cell:0:0", "table:1:cell:0:1", "table:1:cell:1:0"]
    assert [r.attributes["level"] for r in rows[4:]] == ["0", "1"]


def test_deep_and_long_pages_in_linear_time(spark):
    n = 50_000
    pages = ["<div>" * n + "<p>deep" + "</div>" * n + "<p>after", "<b>" * n + "<p>x", "<ul><li>" * 2000 + "y", "<p>a<b>" * 20_000, "<a href=x>l" * 10_000, None]
    rows = html_facts(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "doc_id bigint, html string").repartition(6)).groupBy("doc_id", "kind").count().collect()
    assert {(r.doc_id, r.kind): r["count"] for r in rows} == {(0, P): 2, (1, P): 1, (2, L): 1, (3, P): 20_000, (4, A): 10_000}
