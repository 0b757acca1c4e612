"""Main text of pages: parsing, alignment, induced wrappers, and the given pages by a plain rule."""
import html
import re

from tessera.llm import queries, wrapper
from tessera.llm.common import tune

PAGE = """<html><body><div class="x1"><a href="/">Home</a> <a href="/n">News</a></div><div class="c"><h1>{title}</h1><p>{a}<p>{b}</p>
<div class="c9">Printed by the same press</div></div><aside>side</aside><div id="comments"><p>{c}</p></div><form>f</form></body></html>"""


def test_wrapper_finds_the_varying_slot(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(title=f"Title {i}", a=f"First &amp; words {i} " * 5, b=f"second\n  part {i}", c=f"reader {i}"), "x") for i in range(12)]
    rows += [(50, "http://one.example/", "<main><p>alone</p></main><footer>f</footer>", "x"), (51, None, None, "x"), (52, "odd", "", "x"), (52, "odd", "", "x"),
             (53, "http://h.example/z", "<p>other &lt;shape<script>x</script>", "x"), (None, "http://h.example/n", "<article>n</article>", "x")]
    df = tune(spark).createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {}
    for r in wrapper.main_text(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    for i in range(12):
        assert got[i] == [f"Title {i}\n" + " ".join([f"First & words {i}"] * 5) + f"\nsecond part {i}"]
    assert got[50] == ["alone"] and got[51] == [""] and got[52] == ["", ""] and got[53] == ["other <shape"] and got[None] == ["n"]
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_comments_longer_than_the_article(spark):
    page = "<html><body><article><h1>Title {i}</h1><p>{a}</p></article><div class=comments>{c}</div><div><p>{b}</p></div><div id=related><p>{c}</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i=i, a=f"story {i} " * 5, b=f"note {i}", c=f"<p>reader {i} says</p>" * 40)) for i in range(12)]
    # No article element, and comments of the same kind as the story.
    other = "<html><body><div><p>{a}</p></div><div id=comments><p>{c}</p></div></body></html>"
    rows += [(100 + i, f"http://o.example/{i}", other.format(a=f"story {i} " * 5, c=f"reader {i} " * 90)) for i in range(12)]
    got = {r.page_id: r.text for r in wrapper.main_text(tune(spark).createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(12):
        story = " ".join([f"story {i}"] * 5)
        assert got[i] == f"Title {i}\n{story}" and got[100 + i] == story


def test_copies_of_one_article_are_no_template(spark):
    page = "<html><body><article><h1>{h}</h1><p>{a}</p><div class=by>{by}</div><div class=box>Box<p>{b}</p></div></article></body></html>"
    same = "one hot story " * 20
    rows = [(i, f"http://h.example/{i}", page.format(h=f"Headline {i % 60}", a=same, by="All rights", b="same box")) for i in range(95)]
    rows += [(100 + i, f"http://h.example/o{i}", page.format(h=f"Other {i}", a=f"story {i} " * 20, by="All rights", b=f"box {i}")) for i in range(5)]
    # Many stories: the constant line goes, but not the one page's own text in its place.
    rows += [(200 + i, f"http://m.example/{i}", page.format(h=f"Title {i}", a=f"tale {i} " * 20, by="All rights" if i else "By a reader", b=f"box {i}")) for i in range(20)]
    rows += [(300 + i, f"http://m.example/c{i}", page.format(h=f"Copy {i}", a=same, by="All rights", b="box")) for i in range(300)]
    got = {r.page_id: r.text.split("\n") for r in wrapper.main_text(tune(spark).createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(95):
        assert got[i] == [f"Headline {i % 60}", same.strip(), "All rights", "Box", "same box"]
    for i in range(5):
        assert got[100 + i][:2] == [f"Other {i}", " ".join([f"story {i}"] * 20)]
    for i in range(20):
        assert got[200 + i] == [f"Title {i}", " ".join([f"tale {i}"] * 20), *([] if i else ["By a reader"]), "Box", f"box {i}"]
    assert all(got[300 + i] == [f"Copy {i}", same.strip(), "Box", "box"] for i in range(300))


def test_deep_pages_beside_others_and_alone(spark):
    deep = "<html><body><div class=top>Home</div>" + "<div>" * 50000 + "<p>far {i} down</p><p>and on</p>"
    rows = [(i, f"http://h.example/{i}", deep.format(i=i)) for i in range(12)]
    rows += [(100 + i, f"http://h.example/g{i}", f"<html><body><div class=top>Home</div><article><p>story {i}</p></article></body></html>") for i in range(12)]
    rows += [(200, "http://one.example/", deep.format(i=200)), (201, "http://two.example/", "<div>" * 1500 + "<article><p>within</p></article><p>outside</p>")]
    got = {r.page_id: r.text for r in wrapper.main_text(tune(spark).createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i in [*range(12), 200]:
        assert f"far {i} down\nand on" in got[i]
    assert all(f"story {i}" in got[100 + i] for i in range(12)) and "within" in got[201]


def test_blocks_and_odd_markup():
    text = lambda page: "\n".join(wrapper.blocks([wrapper.parse(page)]))
    assert text("<p>a<b>b</b> c<br>d<p>e&nbsp;f &copy &#65;") == "ab c d\ne f © A"
    assert text("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>x") == "1\n2\n3\n4\nx"
    assert text("<table><tr><td>a<td>b<tr><td>c</table></p></div>d") == "a\nb\nc\nd"
    assert text("a<!-- <p>no --><script>'</p>'</script>b < c <style>") == "ab < c"
    assert text("<p title='>'>q</p><p title=\"unclosed>r") != ""
    assert text("<div>" * 50000 + "deep") == "deep"
    assert len(text("<p " + "a='b' " * 200000 + ">z</p>")) == 1
    assert text("<" * 200000).startswith("<")


def test_simple_tree_matching_keeps_order():
    a = wrapper.Slot("html", [wrapper.parse("<body><div class=a>x</div><p>t</p><div class=b><h1>h</h1><p>u</p></div></body>")])
    b = wrapper.outline(wrapper.Slot("html", [wrapper.parse("<body><p>1</p><div class=b><p>2</p></div><div class=c>3</div></body>")]))
    size, pairs = wrapper.tree_match(a, b)
    assert size == 5 and [p for p, _ in pairs][1:] == ["/html/body", "/html/body/div.b", "/html/body/div.b/p", "/html/body/p"]


def test_given_pages(spark):
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.01"
    source = {r["page_id"]: r for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}

    def plain(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = (" ".join(html.unescape(p.replace("<br>", " ").replace("<b>", "").replace("</b>", "")).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        return "\n".join(p for p in parts if p)

    rows = queries.QUERIES["op5_wrapper"](spark, sf).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r.text == plain(source[r.page_id]["html"]) and r.n_chars == len(r.text) and r.url == source[r.page_id]["url"]
