"""Metrics, matches and scores on small cases with known answers and against brute force."""
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import corpus as co
from tessera.operators import match
from tessera.operators import metrics as mt
from tessera.operators import scores as sc
from tessera.operators.facts import html_facts, page_text_facts, txt_facts
from tessera.operators.markdown_facts import markdown_facts
from tessera.operators.numbering import number_in_group, number_rows
from tessera.session import by_document, cut_lineage

CASES = [(1, "Alpha\nBeta", "Alpha\nBeta"), (2, "Alpha", "# Alpha"), (3, "Alpha original", "Beta replacement"),
         (4, "a\nb\nc\nd", "d\n\nc\n\nb\n\na"), (5, "x", ""), (6, "a\nb\nc\nd\ne", "a\n\nc\n\nb\n\ne\n\nd\n\nd"),
         (7, "", ""), (8, "cafe\u0301 x", "caf\u00e9\u00a0x")]


@pytest.fixture(scope="module")
def judged(spark):
    d = spark.createDataFrame(CASES, "doc_id bigint, text string, markdown string")
    s = txt_facts(by_document(d.select("doc_id", "text")))
    o = markdown_facts(by_document(d.select("doc_id", F.lit("a").alias("arm"), "markdown")))
    s, o = mt.comparable(s, o)
    pairs = d.select("doc_id", F.lit("txt").alias("format"), F.lit("a").alias("arm"))
    wide = cut_lineage(mt.comparison_row(pairs, s, o))
    metrics = mt.metrics_of(wide)
    families, dimensions, docs = sc.score_tables(wide, metrics)
    found = mt.row_findings(wide).unionByName(mt.missing_findings(pairs, s, o))
    assessed = sc.presentation_verdicts(sc.assessments(pairs, metrics, found, dimensions, docs))
    return {"metrics": {(r.doc_id, r.name): r for r in metrics.collect()}, "docs": {r.doc_id: r for r in docs.collect()},
            "findings": {(r.doc_id, r.code) for r in found.collect()}, "assessed": {r.doc_id: r for r in assessed.collect()}}


def test_golden_scores(judged):
    d, m = judged["docs"], judged["metrics"]
    assert (d[1].score, d[1].status, judged["assessed"][1].evaluation_coverage) == (100.0, "PARTIAL_EVIDENCE", 66.7)
    assert (d[2].score, d[2].status, d[2].eligibility) == (75.0, "SCORED", "ELIGIBLE_DOCUMENT_LEVEL")
    assert (m[2, "heading_precision"].status, m[2, "heading_precision"].value) == ("EVALUATED", 0.0)
    assert m[3, "text_recall"].value == 0.0
    assert (m[4, "pairwise_order_accuracy"].numerator, m[4, "pairwise_order_accuracy"].denominator) == (0, 6)
    assert (m[6, "pairwise_order_accuracy"].numerator, m[6, "pairwise_order_accuracy"].denominator) == (8, 10)
    assert m[1, "pairwise_order_accuracy"].status == "NOT_EVALUATED_INSUFFICIENT_ANCHORS"
    assert m[7, "output_nonempty"].status == "NOT_APPLICABLE" and m[7, "text_recall"].value is None
    assert m[8, "text_recall"].value == 1.0  # composed and decomposed text are equal
    assert (5, "EMPTY_OUTPUT") in judged["findings"] and (6, "EXTRA_OR_DUPLICATED_CONTENT") in judged["findings"]
    assert not [f for f in judged["findings"] if f[0] == 1]


def test_verdict_thresholds(spark):
    rows = [("QUALIFIED_BOUNDED", "SCORED", 95.0, 100.0, "OK"), ("QUALIFIED_BOUNDED", "SCORED", 80.0, 100.0, "REVIEW"),
            ("QUALIFIED_BOUNDED", "SCORED", 50.0, 100.0, "FAIL"), ("QUALIFIED_BOUNDED", "PARTIAL_EVIDENCE", 100.0, 99.0, "REVIEW"),
            ("COVERAGE_ONLY", None, None, None, "PARTIAL"), ("QUALIFIED_BOUNDED", "SCORED", 99.0, 80.0, "REVIEW"),
            ("NOT_QUALIFIED", None, None, None, "NOT_EVALUATED")]
    df = spark.createDataFrame(rows, "qualification_status string, projection_status string, fidelity_score double, evaluation_coverage double, want string")
    assert all(r.want == r.verdict for r in sc.presentation_verdicts(df).collect())


def test_partial_is_decided_on_pair_counts(spark):
    wide = spark.createDataFrame([(1, 4001, 4000)], "doc_id bigint, t_said bigint, o_exact bigint")
    for c in mt.SOURCE_COUNTS:
        if c not in wide.columns:
            wide = wide.withColumn(c, F.lit(0))
    order = sc.opportunities_of(wide, "doc_id").filter("family = 'reading_order'").first()
    assert (order.source_opportunities, order.evaluable_opportunities) == (8002000, 7998000)


def test_overlap_fifo_and_inversions_against_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "b", "c", "d e", "d f", "e"]
    docs = [(i, [rng.choice(words) for _ in range(rng.randint(0, 12))], [rng.choice(words) for _ in range(rng.randint(0, 12))]) for i in range(60)]
    docs += [(100 + i, [str(x) for x in range(20)], [str(x) for x in rng.sample(range(20), 20)]) for i in range(20)]
    d = spark.createDataFrame([(i, "\n".join(s), "\n\n".join(o)) for i, s, o in docs], "doc_id bigint, text string, markdown string")
    s, o = mt.comparable(txt_facts(d.select("doc_id", "text")), markdown_facts(by_document(d.select("doc_id", F.lit("x").alias("arm"), "markdown"))))
    overlap = {r.doc_id: r.matched for r in match.token_overlap(match.compared_items(s, o), s).collect()}
    pairs = match.match_text_fifo(s, o).select("doc_id", "arm", "source_ord", "output_ord")
    got = defaultdict(list)
    for r in pairs.collect():
        got[r.doc_id].append((r.source_ord, r.output_ord))
    inverted = {r.doc_id: r.inversions for r in match.inversions(pairs).collect()}
    for i, src, out in docs:
        tokens = lambda xs: Counter(t for x in xs for t in x.split())
        assert overlap.get(i, 0) == sum((tokens(src) & tokens(out)).values())
        queues = defaultdict(list)
        for k, x in enumerate(out):
            queues[x].append(k)
        want = [(k, queues[x].pop(0)) for k, x in enumerate(src) if queues[x]]
        assert sorted(got[i]) == want
        assert inverted.get(i, 0) == sum(a[1] > b[1] for n, a in enumerate(want) for b in want[n + 1:])


def test_inexact_facts_are_not_scored_as_zero(spark):
    t = spark.createDataFrame([(1, 1, "one"), (1, 2, " "), (1, 3, "two")], "doc_id bigint, page bigint, text string")
    facts = page_text_facts(t)
    assert [(r.fact_id, r.ord) for r in facts.orderBy("ord").collect()] == [("text:1", 0), ("text:2", 1)]
    o = markdown_facts(spark.createDataFrame([(1, "a", "one")], "doc_id bigint, arm string, markdown string"))
    s, o = mt.comparable(facts, o)
    pairs = spark.createDataFrame([(1, "pdf", "a")], "doc_id bigint, format string, arm string")
    m = {r.name: r for r in mt.metrics(pairs, s, o).collect()}
    assert m["evaluation_coverage_exact"].value == 0.0
    assert m["text_recall"].status == m["duplicate_or_extra_content_count"].status == "NOT_EVALUATED_SOURCE_CERTAINTY"
    assert m["text_recall"].value is None


def test_numbering_splits_groups(spark):
    df = spark.createDataFrame([("k", i * 3) for i in range(50)] + [("z", 7)], "k string, o bigint")
    got = {(r.k, r.o): r.n for r in number_in_group(df, ["k"], "o", "n", chunk=10).collect()}
    assert got == {**{("k", i * 3): i for i in range(50)}, ("z", 7): 0}
    ranked = {r.o: r.n for r in number_rows(df.filter("k = 'k'"), [F.col("o").desc()], "n").collect()}
    assert ranked == {i * 3: 50 - i for i in range(50)}


MARKDOWN = """# Title *em* &amp;

para one
continues **bold** [link](http://a.b/c "T") `co*de`

Setext
======

* a
  cont
* b
  * c [![alt](i.png)](x)
    1. deep
* d

| A | B |
| --- | --- |
| x \\| y | z |

````py
# not
```
* no
````

> quoted
lazy

<div>
x
</div>

    code
---
last \\*esc\\* <b>x</b>
1986. A great
"""


def test_markdown_dialect(spark):
    rows = markdown_facts(spark.createDataFrame([(1, "a", MARKDOWN)], "doc_id bigint, arm string, markdown string")).orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(len(rows)))
    got = [(r.kind, r.text, (r.attributes or {}).get("level") or (r.attributes or {}).get("target")) for r in rows]
    assert got == [
        ("HEADING", "Title em ", "1"), ("TEXT_BLOCK", "para one\ncontinues bold link co*de", None), ("LINK", "link", "http://a.b/c"),
        ("HEADING", "Setext", "1"), ("LIST_ITEM", "a\ncont", "0"), ("LIST_ITEM", "b", "0"), ("LIST_ITEM", "c alt", "1"), ("LINK", "alt", "x"),
        ("IMAGE", "alt", "i.png"), ("LIST_ITEM", "deep", "2"), ("LIST_ITEM", "d", "0"), ("TABLE", None, None), ("TABLE_CELL", "A", None),
        ("TABLE_CELL", "B", None), ("TABLE_CELL", "x | y", None), ("TABLE_CELL", "z", None), ("TEXT_BLOCK", "quoted\nlazy", None),
        ("TEXT_BLOCK", "last *esc* x\n1986. A great", None)]


HTML = ("<h1>T &amp; x</h1><p><b>De<br><p>Oi &#233;&eacute; <i>a</i></p><ul><li>a<ul><li>b <a href=\"/x y\">l</a></ul><li>c</ul>"
        "<table><tr><th>H<th>I<tr><td>1<ul><li>q</li></ul><td>2 <a href='z'>zz</a></table><img src=a.png alt=\"A\">"
        "<script>var t=\"</p>\"</script><h2>two")


def test_html_ownership(spark):
    rows = html_facts(spark.createDataFrame([(1, HTML)], "doc_id bigint, html string")).orderBy("ord").collect()
    assert [(r.fact_id, r.text) for r in rows] == [
        ("heading:1", "T & x"), ("text:2", "De"), ("text:3", "Oi \u00e9\u00e9 a"), ("list:4", "a"), ("list:5", "b l"), ("link:6", "l"), ("list:7", "c"),
        ("table:1", None), ("table:1:cell:0:0", "H"), ("table:1:cell:0:1", "I"), ("table:1:cell:1:0", "1 q"), ("table:1:cell:1:1", "2 zz"),
        ("link:13", "zz"), ("image:14", "A"), ("heading:15", "two")]
    assert rows[4].attributes["level"] == "1" and rows[7].attributes == {"rows": "2", "columns": "2"}


def test_exact_median_by_rank(spark):
    import statistics
    rng = random.Random(2)
    groups = {"odd": [rng.uniform(-5, 5) for _ in range(501)], "even": [rng.gauss(0, 1e6) for _ in range(500)], "hot": [0.0] * 900 + [rng.random() for _ in range(100)], "one": [3.5], "two": [1.0, 2.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("odd", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "plan_id string, delta double").repartition(7)
    got = {r.plan_id: r.median for r in co.exact_median(df, ["plan_id"], "delta").collect()}
    assert got == {**{k: 0.5 * a + 0.5 * b for k, vs in groups.items() for a, b in [(statistics.median_low(vs), statistics.median_high(vs))]}, None: 7.0}
    full = {r.plan_id: r for r in co.paired_delta_summary(df, ["plan_id"]).collect()}
    assert full["two"].median_delta == 1.5 and full["none"].median_delta is None and full["none"].pairs == 1 and full["hot"].equal == 900


def test_corpus_projection_and_comparison(spark):
    plan = spark.createDataFrame([("p", "1", "txt", "s", i) for i in (1, 2)] + [("p", "1", "html", "t", 3)] + [("q", "1", "txt", "s", 9)],
                                 "plan_id string, plan_version string, format string, stratum string, doc_id bigint")
    row = lambda i, f, s, v: (i, f, s, v, "SCORED", "ELIGIBLE_DOCUMENT_LEVEL", "m", "t")
    schema = "doc_id bigint, format string, stratum string, score double, status string, eligibility string, methodology_version string, target_profile string"
    left = spark.createDataFrame([row(1, "txt", "s", 90.0), row(2, "txt", "s", 91.0), row(3, "html", "t", 80.0)], schema)
    right = spark.createDataFrame([row(1, "txt", "s", 80.0), row(2, "txt", "s", 91.0), row(3, "html", "t", 70.0)], schema)
    l, r = co.project_corpus(plan, left), co.project_corpus(plan, right)
    score = {x.plan_id: (x.status, x.score) for x in l[3].collect()}
    assert score == {"p": ("ELIGIBLE", 85.2), "q": ("NOT_ELIGIBLE", None)}
    got = {x.plan_id: x for x in co.compare_corpora(l[0], l[3], r[0], r[3]).collect()}
    assert (got["p"].status, got["p"].corpus_delta, got["p"].pairs, got["p"].median_delta, got["p"].positive, got["p"].equal) == ("COMPARABLE", 7.4, 3, 10.0, 2, 1)
    assert got["q"].status == "NOT_COMPARABLE" and got["q"].pairs is None


def test_long_constructs_end_no_job(spark):
    from tessera.functions import html as fh
    from tessera.functions import markdown as fm
    word = "word " * 200_000
    rows = ["[" + word, "[" + word + "](t)", "``" + word + "``", "![" + word + "](x)", "[a](" + "x" * 1_000_000 + ")", "[" + "!" * 1_000_000, "short [l](t)"]
    got = [r.t for r in spark.createDataFrame([(m,) for m in rows], "m string").select(fm.inline_text(F.col("m")).alias("t")).collect()]
    assert got[6] == "short l" and got[1].strip() == word.strip() and got[2].strip() == word.strip() and len(got[0]) > 900_000
    page = "<p " + "a='b' " * 200_000 + ">text</p>&#9999999;&#x110000;&#0;&#xD800;&#65;"
    text = spark.createDataFrame([(page,)], "h string").select(fh.strip_tags(F.col("h")).alias("t")).first().t
    assert text == "text" + "�" * 4 + "A"


REFERENCES = """See [Foo  Bar], [text][foo bar], [x][], [nope] and [nope][foo bar] ![pic][img].

[foo bar]: <http://a.b/c d> "Ti\\"tle"
[FOO BAR]: /second
[img]: i.png 'P'
[x]: not a definition

para
[para]: /not-a-def

[a][b][baz] [foo][] ![X] [![alt][img]][baz] \\[baz] `[baz]` [*em* q](u) [see ![k](z.png)] [para]

[baz]: /baz
  (in parens)

* item [baz] www.example.com/a_b_c, then http://x.y/z).
* (https://en.wiki.org/w/A_(b)) mailto:joe@ex.com tel:+123 nohttp://x.y [in http://l.k/ t] http://bad/ http://ok.com?a=1&b=2

*http://em.ph/x* after [open http://no.link/ here

> [q]: /quoted

[q] and [B][q]
===

```
[code]: /no
```
[code]
"""


def test_references_and_bare_links(spark):
    rows = markdown_facts(spark.createDataFrame([(1, "a", REFERENCES)], "doc_id bigint, arm string, markdown string")).orderBy("ord").collect()
    got = [(r.kind, r.text, *((r.attributes or {}).get(k) for k in ("target", "title"))) for r in rows]
    block = lambda text, kind="TEXT_BLOCK": (kind, text, None, None)
    assert got == [
        block("See Foo  Bar, text, [x][], [nope] and nope pic."),
        ("LINK", "Foo  Bar", "http://a.b/c d", 'Ti"tle'), ("LINK", "text", "http://a.b/c d", 'Ti"tle'), ("LINK", "nope", "http://a.b/c d", 'Ti"tle'), ("IMAGE", "pic", "i.png", "P"),
        block("[x]: not a definition"), block("para\n[para]: /not-a-def"),
        block("[a]b [foo][] ![X] alt [baz] [baz] em q [see k] [para]"),
        ("LINK", "b", "/baz", "in parens"), ("LINK", "alt", "/baz", "in parens"), ("IMAGE", "alt", "i.png", "P"), ("LINK", "em q", "u", None), ("IMAGE", "k", "z.png", None),
        block("item baz www.example.com/a_b_c, then http://x.y/z).", "LIST_ITEM"),
        ("LINK", "baz", "/baz", "in parens"), ("LINK", "www.example.com/a_b_c", "http://www.example.com/a_b_c", None), ("LINK", "http://x.y/z", "http://x.y/z", None),
        block("(https://en.wiki.org/w/A_(b)) joe@ex.com +123 nohttp://x.y [in http://l.k/ t] http://bad/ http://ok.com?a=1&b=2", "LIST_ITEM"),
        ("LINK", "https://en.wiki.org/w/A_(b)", "https://en.wiki.org/w/A_(b)", None), ("LINK", "joe@ex.com", "mailto:joe@ex.com", None), ("LINK", "+123", "tel:+123", None),
        ("LINK", "http://ok.com?a=1&b=2", "http://ok.com?a=1&b=2", None),
        block("http://em.ph/x after [open http://no.link/ here"), ("LINK", "http://em.ph/x", "http://em.ph/x", None),
        block("q and B", "HEADING"), ("LINK", "q", "/quoted", None), ("LINK", "B", "/quoted", None), block("[code]")]


def test_definitions_stay_in_their_document_and_many_are_cheap(spark):
    n = 3000
    text = "\n\n".join(f"see [ref {i}] ok" for i in range(n)) + "\n\n" + "\n".join(f"[REF {i}]: /t{i}" for i in range(n))
    rows = [(1, "a", "[k]: /one"), (2, "a", "[k]"), (1, "b", "[k]\n\n[k]: /two"), (3, "a", text)]
    got = markdown_facts(spark.createDataFrame(rows, "doc_id bigint, arm string, markdown string")).filter("kind = 'LINK'").collect()
    links = sorted((r.doc_id, r.arm, r.text, r.attributes["target"]) for r in got)
    assert links == sorted([(1, "b", "k", "/two")] + [(3, "a", f"ref {i}", f"/t{i}") for i in range(n)])


def test_list_levels_against_a_stack_and_a_long_list(spark):
    rng = random.Random(11)
    docs, want = [], {}
    for d in range(40):
        lines, stack, levels, indent = [], [], [], 0
        for i in range(rng.randint(1, 25)):
            indent = max(0, min(indent + rng.choice([-4, -3, -2, -1, 0, 0, 1, 2, 3]), 12)) if i else 0
            gap = rng.randint(1, 4)
            stack = [c for c in stack if c <= indent]
            levels.append(len(stack))
            stack.append(indent + 1 + gap)
            lines.append(" " * indent + "*" + " " * gap + f"w{i}")
        docs.append((d, "a", "\n".join(lines)))
        want[d] = levels
    n = 100_000
    docs.append((99, "a", "\n".join("* a" if i % 2 == 0 else "    * b" for i in range(n))))
    facts = markdown_facts(spark.createDataFrame(docs, "doc_id bigint, arm string, markdown string").repartition(8, "doc_id"))
    levels = facts.filter("kind = 'LIST_ITEM'").select("doc_id", "ord", F.element_at("attributes", "level").cast("int").alias("level"))
    got = defaultdict(list)
    for r in levels.filter("doc_id < 99").orderBy("doc_id", "ord").collect():
        got[r.doc_id].append(r.level)
    assert dict(got) == want
    assert levels.filter("doc_id = 99").agg(F.count("*").alias("n"), F.sum("level").alias("s"), F.sum(F.expr("level * (ord % 2)")).alias("odd")).first()[:] == (n, n // 2, n // 2)
