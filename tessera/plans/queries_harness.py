"""Queries on the evaluation harness, JSON conversion, sheets and progress."""
from pyspark.sql import functions as F

from ..functions import jsontext
from ..functions import ooxml as ox
from ..functions import text as tx
from ..operators import harness as hs
from ..session import scratch
from ..streaming.progress import progress_fold, progress_history, progress_stream
from . import views
from .oracle import decode, lit, rr
from .registry import register

_WS = tx.WS
_squash = lambda x: f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"
_ACTUAL = "'# ' || replace(replace(text, 'th', 'tb'), '. ', '.' || chr(10))"
_ACTUAL_SP = "concat('# ', replace(replace(text, 'th', 'tb'), '. ', '.\\n'))"
_BYTES = "regexp_replace({}, '[^\\x00-\\x7F]', '?', 'g')"


@register("char_error_rate", f"""
SELECT id, want = got AS exact_match, e AS character_errors, round_even(e::DOUBLE / n * 100, 2) AS cer_percent, round_even((n - e)::DOUBLE / n * 100, 2) AS recall_percent,
  round_even((1 - e::DOUBLE / n) * 100, 2) AS accuracy_percent, len(string_split(want, ' ')) = len(string_split(got, ' ')) AS word_count_match
FROM (SELECT *, levenshtein({_BYTES.format('want')}, {_BYTES.format('got')}) AS e, length(want) AS n FROM (
  SELECT id, {_squash('text')} AS want, {_squash("regexp_replace(" + _ACTUAL + ", '(?m)^#+" + _WS + "*', '', 'g')")} AS got FROM (
    SELECT 'b' || item_id AS id, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations)))""")
def _(spark, sf_dir):
    b = views.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    c = views.table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), "text")
    rows = b.unionByName(c).withColumn("actual", F.expr(_ACTUAL_SP))
    return rows.select("id", *[v.alias(k) for k, v in tx.character_errors(F.col("text"), F.col("actual")).items()])


@register("determinism_check", """SELECT doc_id AS id, a = b AS is_identical, strlen(text)::BIGINT AS bytes, a AS run1_sha256, b AS run2_sha256
FROM (SELECT doc_id, text, sha256(text) AS a, sha256(replace(text, '***', '**')) AS b FROM documents)""")
def _(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("markdown"))
    return hs.determinism_check(d, d.withColumn("markdown", F.replace("markdown", F.lit("***"), F.lit("**"))))


@register("expectation_gate", """SELECT fixture, arm, reason FROM (SELECT doc_id AS fixture, lang AS arm, CASE WHEN coalesce(toxic = 1, false) THEN CASE WHEN n_chars > 200 THEN 'Expected to fail, but succeeded' END
  WHEN n_chars <= 200 THEN 'TooShort' WHEN n_chars % 50 = 0 AND NOT coalesce(quality = 0, false) THEN 'Zero characters extracted' END AS reason FROM documents LEFT JOIN labels USING (doc_id)) WHERE reason IS NOT NULL""")
def _(spark, sf_dir):
    runs = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("fixture"), F.col("lang").alias("arm"), F.expr("n_chars > 200 AS success"),
        F.expr("CASE WHEN n_chars <= 200 THEN 'TooShort' END AS error"), F.expr("CASE WHEN n_chars % 50 = 0 THEN 0 ELSE n_chars END AS char_count"))
    expected = views.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("fixture"), F.expr("toxic = 1 AS must_fail"), F.expr("quality = 0 AS may_be_empty"))
    return hs.expectation_gate(runs, expected)


@register("provenance_check", f"""SELECT conv_id * 1000000 AS id, count(*) FILTER (turn % 3 <> 0 AND role <> 'system') AS valid_count, count(*) FILTER (turn % 3 <> 0 AND role <> 'system') > 0 AS has_boxes FROM conversations GROUP BY 1""")
def _(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    box = F.expr("struct(CAST(0 AS DOUBLE) AS l, CAST(1 AS DOUBLE) AS t, CAST(length(text) AS DOUBLE) AS r, CASE WHEN turn % 3 <> 0 THEN CAST(2 AS DOUBLE) END AS b)")
    prov = F.array(F.struct(F.expr("CASE WHEN role <> 'system' THEN turn END").alias("page_no"), box.alias("bbox")))
    texts = c.select(F.expr("conv_id * 1000000").alias("id"), F.struct(prov.alias("prov")).alias("t"))
    return hs.provenance_check(texts.groupBy("id").agg(F.collect_list("t").alias("texts")))


_TAGS = r"(?s)<[a-zA-Z/!][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>"


@register("direct_extract_baseline", f"""SELECT id, text, length(text) AS char_count, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS line_count
FROM (SELECT page_id AS id, {decode(rr(rr('html', '(?s)<!--.*?-->', ''), _TAGS, ''))} AS text FROM pages)""")
def _(spark, sf_dir):
    return hs.direct_extract(views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html"))


_CELLS = f"""SELECT conv_id * 1000000 AS workbook, role AS sheet, turn AS row, unnest([0, 1, 2]) AS col, unnest([turn::VARCHAR, CASE WHEN turn % 4 = 3 THEN NULL ELSE role END, text]) AS value FROM conversations"""


def cells(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    values = F.expr("array(CAST(turn AS STRING), CASE WHEN turn % 4 <> 3 THEN role END, text)")
    return c.select(F.expr("conv_id * 1000000").alias("workbook"), F.col("role").alias("sheet"),
                    F.col("turn").alias("row"), F.posexplode(values).alias("col", "value"))


@register("sheet_text", f"""SELECT workbook, string_agg('### Sheet: ' || sheet || chr(10) || body, chr(10) || chr(10) ORDER BY sheet) AS text FROM (
SELECT workbook, sheet, string_agg(line, chr(10) ORDER BY row) AS body FROM (SELECT workbook, sheet, row, string_agg(coalesce(value, ''), ' | ' ORDER BY col) AS line FROM ({_CELLS}) GROUP BY ALL) WHERE trim(line) <> '' GROUP BY ALL) GROUP BY workbook""")
def _(spark, sf_dir):
    return hs.sheet_text(cells(spark, sf_dir))


@register("sheet_inventory", f"""SELECT w.workbook, w.sheet, CASE v WHEN -1 THEN 'visible' WHEN 2 THEN 'veryHidden' ELSE 'hidden' END AS visibility, coalesce(n, 0) = 0 AS is_empty
FROM (SELECT workbook, unnest(['user', 'assistant', 'notes']) AS sheet, unnest([-1, 0, 2]) AS v FROM (SELECT DISTINCT workbook FROM ({_CELLS}))) w
LEFT JOIN (SELECT workbook, sheet, count(*) FILTER (coalesce(value, '') <> '') AS n FROM ({_CELLS}) GROUP BY ALL) c ON c.workbook = w.workbook AND c.sheet = w.sheet""")
def _(spark, sf_dir):
    c = cells(spark, sf_dir)
    sheets = c.select("workbook").distinct().select("workbook", F.explode(F.expr(
        "array(struct('user' AS sheet, -1 AS visible), struct('assistant' AS sheet, 0 AS visible), struct('notes' AS sheet, 2 AS visible))")).alias("s")).select("workbook", "s.*")
    return hs.sheet_inventory(sheets, c)


@register("arm_pivot", """SELECT doc_id AS fixture, round(n_chars / 1000000.0::DOUBLE, 4) AS direct_seconds, n_chars > 100 AS direct_ok, round(n_chars / 1000.0::DOUBLE, 4) AS heavy_seconds, lang <> 'de' AS heavy_ok FROM documents""")
def _(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    runs = d.select(F.col("doc_id").alias("fixture"), F.explode(F.expr("""array(
        struct('direct' AS arm, n_chars / 1000000.0D AS duration_seconds, n_chars > 100 AS success),
        struct('heavy' AS arm, n_chars / 1000.0D AS duration_seconds, lang <> 'de' AS success))""")).alias("r")).select("fixture", "r.*")
    return hs.arm_pivot(runs, ["direct", "heavy"])


_PROPS = "CASE WHEN event_id % 10 = 9 THEN substr(props, 2) ELSE props END"


@register("json_to_text", f"""SELECT event_id, CASE WHEN ok THEN regexp_replace(regexp_replace(p, '^\\{{', '{{' || chr(10) || '  '), '\\}}$', chr(10) || '}}') END AS text, CASE WHEN NOT ok THEN 'invalid_json' END AS error_code
FROM (SELECT event_id, {_PROPS} AS p, json_valid({_PROPS}) AS ok FROM events)""")
def _(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", F.expr(_PROPS).alias("p"))
    e = e.withColumn("text", jsontext.json_to_text(F.col("p")))
    return e.select("event_id", "text", jsontext.json_error(F.col("p"), F.col("text")).alias("error_code"))


@register("json_to_markdown", """SELECT event_id, '# event-' || event_id || '.json' || chr(10) || chr(10) || repeat('`', greatest(3, r + 1)) || 'json' || chr(10) || j || chr(10) || repeat('`', greatest(3, r + 1)) || chr(10) AS markdown
FROM (SELECT event_id, j, coalesce(list_max(list_transform(regexp_extract_all(j, '`+'), lambda x: length(x))), 0) AS r FROM (SELECT event_id, props || repeat('`', (event_id % 5)::INT) AS j FROM events))""")
def _(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", F.expr("concat(props, repeat('`', CAST(event_id % 5 AS INT)))").alias("j"))
    return e.select("event_id", tx.json_markdown(F.concat(F.lit("event-"), "event_id", F.lit(".json")), F.col("j")).alias("markdown"))


_REF = "chr((65 + event_id % 26)::INT) || CASE WHEN event_id % 3 = 0 THEN chr((97 + user_id % 26)::INT) ELSE '' END || CASE WHEN event_id % 7 <> 0 THEN (event_id // 7)::VARCHAR ELSE '' END"
_REF_SP = "concat(char(65 + event_id % 26), CASE WHEN event_id % 3 = 0 THEN char(97 + user_id % 26) ELSE '' END, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id DIV 7 AS STRING) ELSE '' END)"


_REFS = f"(SELECT event_id, upper(regexp_extract(ref, '^([A-Za-z]*)', 1)) AS l, regexp_extract(ref, '^[A-Za-z]*([0-9]*)', 1) AS d FROM (SELECT event_id, {_REF} AS ref FROM events))"


@register("cell_column_index", f"SELECT event_id, CASE WHEN length(l) = 1 THEN ascii(l) - 65 ELSE (ascii(l) - 64) * 26 + ascii(substr(l, 2)) - 65 END AS col_index FROM {_REFS}")
def _(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", F.expr(_REF_SP).alias("ref"))
    return e.select("event_id", ox.cell_column_index(F.col("ref")).alias("col_index"))


@register("cell_row_index", f"SELECT event_id, CASE WHEN d = '' OR d::INT = 0 THEN -1 ELSE d::INT - 1 END AS row_index FROM {_REFS}")
def _(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", F.expr(_REF_SP).alias("ref"))
    return e.select("event_id", ox.cell_row_index(F.col("ref")).alias("row_index"))


def events(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("operation"), "event_id", "ts", F.floor("value").cast("int").alias("pct"),
                    F.expr("event_type = 'purchase' AND value > 60 AS success"))


_EVENTS = "SELECT user_id AS operation, event_id, ts, greatest(0, least(floor(value)::INT, 99)) AS pct, event_type = 'purchase' AND value > 60 AS success FROM events"


@register("progress_fold", f"SELECT operation, CASE WHEN bool_or(success) THEN 100 ELSE max(pct) END AS percent FROM ({_EVENTS}) GROUP BY operation")
def _(spark, sf_dir):
    return progress_fold(events(spark, sf_dir))


@register("progress_stream", f"SELECT operation, CASE WHEN bool_or(success) THEN 100 ELSE max(pct) END AS percent FROM ({_EVENTS}) GROUP BY operation")
def _(spark, sf_dir):
    """The earlier half of the events through the stream, then the later one after a restart."""
    path, rows = scratch(spark), events(spark, sf_dir).drop("event_id").withColumn("ts", F.col("ts").cast("timestamp"))
    half = rows.agg(F.expr("percentile_approx(unix_micros(ts), 0.5)").alias("m"))

    def report(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    for name, wanted in (("earlier", "unix_micros(ts) <= m"), ("later", "unix_micros(ts) > m")):
        rows.crossJoin(F.broadcast(half)).filter(wanted).drop("m").write.parquet(f"{path}/in/{name}")
        stream = progress_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in/*"))
        stream.writeStream.outputMode("update").foreachBatch(report).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("operation bigint, percent int").parquet(f"{path}/out").groupBy("operation").agg(F.max("percent").alias("percent"))


@register("progress_history", f"""SELECT operation, event_id, pct AS percent FROM (SELECT *, max(pct) OVER (PARTITION BY operation ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_EVENTS}))
WHERE pct > coalesce(before, -1)""")
def _(spark, sf_dir):
    return progress_history(events(spark, sf_dir))
