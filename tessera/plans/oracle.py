"""DuckDB statements that answer the registered queries independently, on the same tables.

Common table expressions are kept by name and pulled in by dependency; expression helpers return
SQL text. The constructs of the Markdown dialect that do not occur in the given tables (fences,
raw HTML, quotes, setext headings, images) are left out here and covered by the tests.
"""
import re

from ..functions import text as tx
from ..operators import markdown_facts as mf
from ..operators.mutations import EXPECTED
from . import dims, views

CTE: dict[str, tuple[str, str]] = {}
# The twin reads pages by rules of its own: these tags end an open paragraph.
BLOCK_TAGS = ["address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
              "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
              "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]

# --- the dialect's tokens, written for this engine: RE2 takes no possessive repeats --------------
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHIELDS = "".join(chr(0xE000 + i) for i in range(len(PUNCTUATION)))
ESCAPE = r"\\[!-/:-@\[-`{-~]"
_LABEL = r"(?:\\.|[^\[\]\\])*"
TARGET = r"\((?:\\.|[^()\s\\]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)"
_IMAGE = rf"!\[{_LABEL}\]{TARGET}"
_LINK = rf"\[(?:\\.|[^\[\]\\]|{_IMAGE})*\]{TARGET}"
_CODE = r"````[^`]+````|```[^`]+```|``(?:[^`]|`[^`])+``|`[^`]+`"
HTML = r"<[A-Za-z/!?][^<>]*>"
ENTITY = r"&[A-Za-z][A-Za-z0-9]+;|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
TOKENS = rf"(?s){ESCAPE}|{_CODE}|{_IMAGE}|{_LINK}|{HTML}|{ENTITY}|[^\\`!\[<&]+|."
SPECIAL = r"[\\`!\[<&*_~]"
_STAR = r"(^|[^\p{L}\p{N}*])\*{1,3}([^\s*](?:[^*]*[^\s*])?)\*{1,3}"
_INWORD = r"()\*{1,3}([\p{L}\p{N}](?:[^*]*[^\s*])?)\*{1,3}"
_UNDERSCORE = r"(^|[^\p{L}\p{N}_])_{1,3}([^\s_](?:[^_]*[^\s_])?)_{1,3}"
_STRIKE = r"(^|[^~])~~([^\s~](?:[^~]*[^\s~])?)~~"
EMPHASIS = (_STAR, _STAR, _INWORD, _UNDERSCORE, _UNDERSCORE, _STRIKE)
TAG_STREAM = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>"
    r"|</?[a-z][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>|<![^>]*>|[^<]+|<"
)


def cte(name: str, needs: str, sql: str) -> None:
    CTE[name] = (needs, sql)


def lit(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def query(needs: str, sql: str) -> str:
    """``sql`` behind the expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for n in CTE[name][0].split():
            visit(n)
        order.append(name)

    for n in needs.split():
        visit(n)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + sql


def values(rows, columns: str) -> str:
    one = lambda v: (strings(v) if isinstance(v, list) else str(v) if isinstance(v, (int, float)) else lit(v))
    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


for _name, (_schema, _rows) in dims.TABLES.items():
    _cols = ", ".join(c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", _schema).split(","))
    cte("dim_" + _name, "", values(_rows, _cols))


# --- expressions -------------------------------------------------------------------------------
def rr(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def extract(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


def trim_ws(x):
    return rr(x, f"^{tx.WS}+|{tx.WS}+$", "")


def collapse(x):
    return f"trim({rr(f"coalesce({x}, '')", tx.WS + '+', ' ')})"


def norm(x):
    return f"trim({rr(f"nfc_normalize(coalesce({x}, ''))", tx.WS + '+', ' ')})"


def tokens(x):
    return f"regexp_extract_all({x}, {lit(tx.TOKEN)})"


def unix(x):
    return f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"


def split(x):
    return f"string_split({x}, chr(10))"


def esc_html(x):
    for raw, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = f"replace({x}, {lit(raw)}, {lit(e)})"
    return x


def esc_md(x):
    indent = r"(?m)^([\t\x{0B}-\r\x{85}\p{Z}]*)"
    x = rr(x, r"([\\*_`\[\]<])", r"\\\1")
    x = rr(x, indent + r"([#>]|- |\+ |---)", r"\1\\\2")
    return rr(x, indent + r"([0-9]{1,9})([.)] )", r"\1\2\\\3")


def esc_label(x):
    return rr(x, r"([\\\[\]])", r"\\\1")


def run(x):
    return f"coalesce(list_max(list_transform(regexp_extract_all({x}, '`+'), lambda r: length(r))), 0)"


def code_span(x):
    pad = f"CASE WHEN starts_with({x}, '`') OR ends_with({x}, '`') THEN ' ' ELSE '' END"
    return f"repeat('`', {run(x)} + 1) || {pad} || {x} || {pad} || repeat('`', {run(x)} + 1)"


def fence(x):
    return f"repeat('`', greatest(3, {run(x)} + 1))"


def code_fence(x, lang):
    clean = rr(f"coalesce({lang}, '')", r"[\x00-\x1F\x7F`\x{85}\p{Z}]", "")
    return f"{fence(x)} || {clean} || chr(10) || {x} || CASE WHEN ends_with({x}, chr(10)) THEN '' ELSE chr(10) END || {fence(x)}"


def anchor_id(x):
    kept = rr(trim_ws(x), r"[^A-Za-z0-9_.\-:/#\t-\r\x{85}\p{Z}]", "")
    dashed = rr(kept, r"[\-:/#\t-\r\x{85}\p{Z}]+", "-")
    return f"coalesce(nullif({rr(dashed, '^-|-$', '')}, ''), 'anchor')"


def scheme(x):
    return f"nullif({extract(x, r'^([A-Za-z0-9+.\-]+):', 1)}, '')"


def cleaned(x):
    return trim_ws(rr(x, r"[\x00-\x1F\x7F]", ""))


def safe_link(x):
    u = cleaned(x)
    return (f"CASE WHEN {u} = '' THEN NULL WHEN starts_with({u}, '#') THEN '#' || {anchor_id(f'substr({u}, 2)')}"
            f" WHEN {scheme(u)} IS NULL OR lower({scheme(u)}) IN ('http', 'https', 'mailto') THEN {u} END")


def safe_image(x):
    u = cleaned(x)
    return (f"CASE WHEN {u} = '' OR starts_with({u}, '#') OR ends_with(lower({extract(u, '^([^?#]*)', 1)}), '.svg') THEN NULL"
            f" WHEN {scheme(u)} IS NULL OR lower({scheme(u)}) IN ('http', 'https') THEN {u} END")


def md_url(x, default="#"):
    for raw, e in ((" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E")):
        x = f"replace({x}, {lit(raw)}, {lit(e)})"
    return f"coalesce({x}, {lit(default)})"


def uri(x):
    v = trim_ws(f"coalesce({x}, '')")
    web = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(.*)$"
    s, host = f"lower({extract(v, web, 1)})", f"lower({extract(v, web, 2)})"
    host = (f"CASE {s} " + " ".join(f"WHEN '{n}' THEN regexp_replace({host}, ':{p}$', '')"
                                    for n, p in (("http", 80), ("https", 443), ("ftp", 21))) + f" ELSE {host} END")
    rest = f"(coalesce(nullif({extract(v, web, 3)}, ''), '/') || {extract(v, web, 4)})"
    rest = (f"list_aggregate(list_transform(regexp_extract_all({rest}, '[\\x00-\\x7F]+|[^\\x00-\\x7F]+'), lambda p: "
            f"CASE WHEN regexp_matches(p, '[^\\x00-\\x7F]') THEN url_encode(p) ELSE p END), 'string_agg', '')")
    for raw, e in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("^", "%5E"), ("`", "%60"), ("{", "%7B"), ("|", "%7C"), ("}", "%7D")):
        rest = f"replace({rest}, {lit(raw)}, {lit(e)})"
    opaque = f"lower({scheme(v)}) || ':' || {extract(v, '^[^:]*:(.*)$', 1)}"
    return (f"CASE WHEN {matches(v, web)} THEN {s} || '://' || {host} || {rest} "
            f"WHEN {matches(v, '^(?i:mailto|urn|data|tel|news|javascript):')} THEN {opaque} ELSE {v} END")


def decode(x):
    for e, c in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&middot;", "\u00b7"),
                 ("&copy;", "\u00a9"), ("&amp;", "&")):
        x = f"replace({x}, {lit(e)}, {lit(c)})"
    return x


def pick(vals, index):
    return f"{strings(vals)}[({index}) + 1]"


# --- inventory ---------------------------------------------------------------------------------
cte("files", "", f"""
SELECT '/corpus/' || relative_path AS source_path, * FROM (
  SELECT CASE WHEN doc_id % 41 = 40 THEN '_converted/' WHEN doc_id % 43 = 42 THEN '../' ELSE source || '/' END
         || CASE WHEN doc_id % 37 = 36 THEN '~$d' WHEN doc_id % 5 = 4 THEN 'D' ELSE 'd' END
         || (doc_id // {len(views.EXTENSIONS)}) || {pick(views.EXTENSIONS, f"doc_id % {len(views.EXTENSIONS)}")} AS relative_path,
         strlen(text)::BIGINT AS size_bytes, sha256(text) AS content_sha256 FROM documents
  UNION ALL
  SELECT 'web/p' || page_id || {pick(['.html', '.htm', '.HTML'], 'page_id % 3')}, strlen(html)::BIGINT, sha256(html) FROM pages)""")
cte("existing", "", f"""
SELECT DISTINCT '/out/' || source || '/D' || (doc_id // {len(views.EXTENSIONS)}) || {pick(['.md', '.MD', '.txt', '.xlsx'], 'doc_id % 4')} AS target_path
FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""")

# --- source facts ------------------------------------------------------------------------------
cte("txt_s", "", f"""
SELECT doc_id, 'line:' || line AS fact_id, 'TEXT_BLOCK' AS kind, text,
       row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS ord, 'txt/line[' || line || ']' AS location,
       'SOURCE_EXACT' AS certainty, NULL::VARCHAR AS text_certainty, NULL::VARCHAR AS level, NULL::VARCHAR AS row_no,
       NULL::VARCHAR AS col_no, NULL::VARCHAR AS target, NULL::VARCHAR AS n_rows, NULL::VARCHAR AS n_cols
FROM (SELECT doc_id * 4 AS doc_id, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line
      FROM (SELECT doc_id, {split(unix('text'))} AS l FROM documents)) WHERE text <> ''""")


def _in(tags):
    return "(" + ", ".join(lit(t) for t in tags) + ")"


def _opens(*tags):
    return f"(tag IN {_in(tags)} AND NOT closing)"


def _closes(*tags):
    return f"(tag IN {_in(tags)} AND closing)"


def _owner(start, stop, w):
    return f"last_value(CASE WHEN {start} THEN pos WHEN {stop} THEN -1 END IGNORE NULLS) OVER {w}"


cte("html_raw", "", f"""
SELECT page_id * 4 + 1 AS doc_id, pos, tok, tag, tag IS NOT NULL AND starts_with(tok, '</') AS closing,
       CASE WHEN {matches('tok', '(?is)^<(script|style)[^a-z0-9]')} THEN {extract('tok', '(?is)^<[a-z]+[^>]*>(.*)</', 1)}
            WHEN NOT starts_with(tok, '<') OR tok = '<' THEN {decode('tok')} END AS piece
FROM (SELECT *, CASE WHEN {matches('tok', '^</?[A-Za-z]')} AND NOT {matches('tok', r'(?is)^<(script|style|template)\b')}
                     THEN lower({extract('tok', '^</?([A-Za-z][A-Za-z0-9]*)', 1)}) END AS tag
      FROM (SELECT page_id, unnest(t) AS tok, unnest(range(len(t))) AS pos
            FROM (SELECT page_id, regexp_extract_all(html, {lit(TAG_STREAM)}) AS t FROM pages)))""")
_page = "(PARTITION BY doc_id ORDER BY pos)"
_list = "(PARTITION BY doc_id, list_depth ORDER BY pos)"
_table = "(PARTITION BY doc_id, table_depth ORDER BY pos)"
_delta = lambda *t: f"sum(CASE WHEN {_opens(*t)} THEN 1 WHEN {_closes(*t)} THEN -1 ELSE 0 END) OVER {_page}"
cte("html_own", "html_raw", f"""
SELECT *, {_owner(_opens('li'), _closes('li') + ' OR ' + _opens('ul', 'ol'), _list)} AS li,
       {_owner(_opens('td', 'th'), "tag IN ('td', 'th', 'tr', 'table', 'thead', 'tbody', 'tfoot')", _table)} AS cell,
       {_owner(_opens('table'), 'false', _table)} AS tbl
FROM (SELECT *, {_delta('ul', 'ol')} AS list_depth, {_delta('table')} AS table_depth,
             {_owner(_opens('p'), 'tag IN ' + _in(BLOCK_TAGS), _page)} AS p,
             {_owner(_opens(*HEADING_TAGS), _closes(*HEADING_TAGS), _page)} AS h,
             {_owner(_opens('a'), _closes('a'), _page)} AS a FROM html_raw)""")
_outside = "NOT (coalesce(cell, -1) >= 0 OR table_depth > 1)"
_no_item = "NOT (coalesce(li, -1) >= 0 OR list_depth > 1)"
_href = r'(?is)[\s"\']href\s*=\s*(?:"([^"]*)"|\'([^\']*)\'|([^\s>"\']+))'
cte("html_s", "html_own", f"""
SELECT doc_id, CASE kind WHEN 'HEADING' THEN 'heading:' WHEN 'TEXT_BLOCK' THEN 'text:' WHEN 'LIST_ITEM' THEN 'list:' ELSE 'link:' END
       || (ord + 1) AS fact_id, kind, text, ord, 'html/' || tag || '[' || pos || ']' AS location, 'SOURCE_EXACT' AS certainty,
       NULL AS text_certainty, CASE kind WHEN 'HEADING' THEN substr(tag, 2, 1) WHEN 'LIST_ITEM' THEN CAST(greatest(list_depth - 1, 0) AS VARCHAR) END AS level,
       NULL AS row_no, NULL AS col_no, target, NULL AS n_rows, NULL AS n_cols
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord FROM (
  SELECT e.*, {collapse('x.text')} AS text FROM (
    SELECT doc_id, pos, tag, list_depth, CASE
        WHEN tag IN {_in(HEADING_TAGS)} AND {_outside} AND {_no_item} THEN 'HEADING'
        WHEN tag = 'p' AND {_outside} AND {_no_item} THEN 'TEXT_BLOCK' WHEN tag = 'li' AND {_outside} THEN 'LIST_ITEM'
        WHEN tag = 'a' AND {matches('tok', _href)} THEN 'LINK' END AS kind,
      CASE WHEN tag = 'a' THEN {decode(f"concat({extract('tok', _href, 1)}, {extract('tok', _href, 2)}, {extract('tok', _href, 3)})")} END AS target
    FROM html_own WHERE NOT closing AND tag IS NOT NULL) e
  LEFT JOIN (
    SELECT doc_id, owner, string_agg(sep || piece, '' ORDER BY pos) AS text FROM (
      SELECT doc_id, pos, piece, p AS owner, '' AS sep FROM html_own WHERE piece IS NOT NULL AND p >= 0
      UNION ALL SELECT doc_id, pos, piece, h, '' FROM html_own WHERE piece IS NOT NULL AND h >= 0
      UNION ALL SELECT doc_id, pos, piece, a, '' FROM html_own WHERE piece IS NOT NULL AND a >= 0
      UNION ALL SELECT doc_id, pos, piece, li, ' ' FROM html_own WHERE piece IS NOT NULL AND li >= 0)
    GROUP BY doc_id, owner, sep) x ON x.doc_id = e.doc_id AND x.owner = e.pos
  WHERE kind IS NOT NULL) WHERE text <> '' OR kind = 'LINK')""")
_block = lambda bits: f"conv_id * 4 + {bits}"
cte("pdf_s", "", f"""
SELECT doc_id, 'text:' || (ord + 1) AS fact_id, 'TEXT_BLOCK' AS kind, text, ord, 'pdf/page[' || (turn + 1) || ']' AS location,
       'INFERRED' AS certainty, NULL AS text_certainty, NULL AS level, NULL AS row_no, NULL AS col_no, NULL AS target, NULL AS n_rows, NULL AS n_cols
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS ord FROM (
  SELECT {_block(2)} AS doc_id, turn, {collapse('text')} AS text FROM conversations) WHERE text <> '')""")
cte("sheet_t", "", f"SELECT {_block(3)} AS doc_id, conv_id, turn::INT AS turn, role, text FROM conversations")
cte("xlsx_s", "sheet_t", """
SELECT doc_id, CASE WHEN r < 0 THEN 'table:1' ELSE 'table:1:cell:' || r || ':' || c END AS fact_id,
       CASE WHEN r < 0 THEN 'TABLE' ELSE 'TABLE_CELL' END AS kind, text,
       row_number() OVER (PARTITION BY doc_id ORDER BY r, c) - 1 AS ord,
       CASE WHEN r < 0 THEN 'xl/sheet1' ELSE 'xl/sheet1/R' || r || 'C' || c END AS location, 'SOURCE_EXACT' AS certainty,
       CASE WHEN r < 0 THEN NULL WHEN conv_id % 3 = 0 AND c = 0 AND r > 0 THEN 'INFERRED'
            WHEN c = 0 AND r > 0 THEN 'DERIVED_EXACT' ELSE 'SOURCE_EXACT' END AS text_certainty, NULL AS level,
       CASE WHEN r >= 0 THEN r::VARCHAR END AS row_no, CASE WHEN r >= 0 THEN c::VARCHAR END AS col_no, NULL AS target,
       CASE WHEN r < 0 THEN (max(r) OVER (PARTITION BY doc_id) + 1)::VARCHAR END AS n_rows, CASE WHEN r < 0 THEN '3' END AS n_cols
FROM (SELECT doc_id, conv_id, turn + 1 AS r, unnest([0, 1, 2]) AS c, unnest([turn::VARCHAR, role, text]) AS text FROM sheet_t
      UNION ALL SELECT doc_id, min(conv_id), 0, unnest([0, 1, 2]), unnest(['turn', 'role', 'text']) FROM sheet_t GROUP BY doc_id
      UNION ALL SELECT doc_id, min(conv_id), -1, -1, NULL FROM sheet_t GROUP BY doc_id)""")
cte("src_facts", "txt_s html_s pdf_s xlsx_s", """
SELECT * FROM txt_s UNION ALL SELECT * FROM html_s UNION ALL SELECT * FROM pdf_s UNION ALL SELECT * FROM xlsx_s""")

# --- output arms -------------------------------------------------------------------------------
cte("page_blocks", "html_s", f"""
SELECT doc_id, block AS ord, kind, text, level,
       CASE WHEN len(links) = 1 AND links[1].text = text THEN '[' || {esc_md('text')} || '](' || {md_url(safe_link('links[1].target'))} || ')' ELSE {esc_md('text')} END AS md,
       CASE WHEN len(links) = 1 AND links[1].text = text THEN '[' || {esc_md('text')} || '](' || {md_url(safe_link("(links[1].target || '/changed')"))} || ')' ELSE {esc_md('text')} END AS changed
FROM (SELECT doc_id, block, max(kind) FILTER (kind <> 'LINK') AS kind, max(text) FILTER (kind <> 'LINK') AS text,
             coalesce(max(level::INT), 0) AS level, coalesce(list({{'text': text, 'target': target}} ORDER BY ord) FILTER (kind = 'LINK'), []) AS links
      FROM (SELECT *, last_value(CASE WHEN kind <> 'LINK' THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) AS block FROM html_s)
      WHERE block IS NOT NULL GROUP BY doc_id, block)""")
_clean_cell = lambda x: trim_ws(f"replace(replace(replace({x}, chr(10), ' '), chr(13), ''), '|', '\\|')")
_gfm = lambda rows: (f"chr(10) || array_to_string(list_transform({rows}, lambda r, i: '| ' || array_to_string(r, ' | ') || ' |' || chr(10)"
                     f" || CASE WHEN i = 1 THEN '| --- | --- | --- |' || chr(10) ELSE '' END), '') || chr(10)")
cte("pair_docs", "page_blocks sheet_t", f"""
SELECT doc_id * 4 AS doc_id, 'txt' AS format, text, list_transform(list_filter({split(unix('text'))}, lambda t: t <> ''),
       lambda t: {{'kind': 'TEXT_BLOCK', 'level': 0, 'md': t, 'changed': t}}) AS blocks FROM documents
UNION ALL SELECT p.page_id * 4 + 1, 'html', NULL, coalesce(b.blocks, []) FROM pages p LEFT JOIN (
  SELECT doc_id, list({{'kind': kind, 'level': level, 'md': md, 'changed': changed}} ORDER BY ord) AS blocks FROM page_blocks GROUP BY doc_id) b
  ON b.doc_id = p.page_id * 4 + 1
UNION ALL SELECT {_block(2)}, 'pdf', NULL, list({{'kind': 'TEXT_BLOCK', 'level': 0, 'md': {esc_md('text')}, 'changed': {esc_md('text')}}} ORDER BY turn)
  FROM conversations GROUP BY ALL
UNION ALL SELECT doc_id, 'xlsx', NULL, [{{'kind': 'TABLE', 'level': 0, 'md': {_gfm('rws')}, 'changed': {_gfm('rws[:len(rws) - 1]')}}}] FROM (
  SELECT doc_id, [['turn', 'role', 'text']] || list([turn::VARCHAR, {_clean_cell(esc_md('role'))}, {_clean_cell(esc_md('text'))}] ORDER BY turn) AS rws
  FROM sheet_t GROUP BY doc_id)""".replace("'pdf', NULL, list(", "'pdf', NULL, list(").replace("FROM conversations GROUP BY ALL", f"FROM conversations GROUP BY {_block(2)}"))
_remake = lambda cond, **f: ("list_transform(blocks, lambda b: CASE WHEN " + cond + " THEN {" + ", ".join(
    f"'{k}': {f.get(k, 'b.' + k)}" for k in ("kind", "level", "md", "changed")) + "} ELSE b END)")
_other = "coalesce(list_max(list_transform(blocks, lambda b, i: CASE WHEN b.md <> blocks[1].md THEN i END)), 1)"
_first_item = "list_min(list_transform(blocks, lambda b, i: CASE WHEN b.kind = 'LIST_ITEM' THEN i END))"
_items = "array_to_string(list_transform(list_filter(blocks, lambda b: b.kind = 'LIST_ITEM'), lambda b: b.md), ' ')"
_doc = """array_to_string(list_transform(blocks, lambda b, i: CASE
  WHEN b.kind = 'HEADING' THEN chr(10) || repeat('#', least(b.level, 6)) || ' ' || b.md || chr(10) || chr(10)
  WHEN b.kind = 'LIST_ITEM' THEN repeat('  ', b.level) || '* ' || b.md || CASE WHEN blocks[i + 1].kind = 'LIST_ITEM' THEN chr(10) ELSE chr(10) || chr(10) END
  WHEN b.kind = 'TABLE' THEN b.md || chr(10) ELSE b.md || chr(10) || chr(10) END), '')"""
cte("arms", "pair_docs", f"""
SELECT doc_id, format, arm, CASE WHEN arm = 'empty' THEN '' WHEN arm = 'clean' AND text IS NOT NULL THEN {unix('text')}
    WHEN arm = 'invent' THEN '# ' || {unix('text')} WHEN trimmed = '' THEN '' ELSE trimmed || chr(10) END AS markdown,
  CASE arm {" ".join(f"WHEN '{a}' THEN '{c}'" for a, c in EXPECTED.items() if c)} END AS expected_code
FROM (SELECT *, {trim_ws(_doc)} AS trimmed FROM (
  SELECT doc_id, format, text, arm, CASE arm
    WHEN 'short' THEN blocks[:CAST(ceil(len(blocks) / 2) AS INT)] WHEN 'dup' THEN blocks || blocks[:1]
    WHEN 'swap' THEN list_transform(blocks, lambda b, i: CASE WHEN i = 1 THEN blocks[{_other}] WHEN i = {_other} THEN blocks[1] ELSE b END)
    WHEN 'head' THEN {_remake("b.kind = 'HEADING'", kind="'TEXT_BLOCK'")}
    WHEN 'list' THEN list_filter(list_transform(blocks, lambda b, i: CASE WHEN i = {_first_item}
         THEN {{'kind': 'TEXT_BLOCK', 'level': 0, 'md': {_items}, 'changed': b.changed}} ELSE b END), lambda b: b.kind <> 'LIST_ITEM')
    WHEN 'level' THEN {_remake("b.kind = 'HEADING'", level="b.level + 1")}
    WHEN 'link' THEN {_remake("b.kind <> 'TABLE'", md="b.changed")}
    WHEN 'table' THEN {_remake("b.kind = 'TABLE'", md="b.changed")} ELSE blocks END AS blocks
  FROM (SELECT *, unnest(CASE format {" ".join(f"WHEN '{f}' THEN {strings(a)}" for f, a in views.ARMS.items())} END) AS arm FROM pair_docs)))""")
cte("pairs", "", f"""
SELECT *, unnest(CASE format {" ".join(f"WHEN '{f}' THEN {strings(a)}" for f, a in views.ARMS.items())} END) AS arm FROM (
  SELECT doc_id * 4 AS doc_id, 'txt' AS format FROM documents UNION ALL SELECT page_id * 4 + 1, 'html' FROM pages
  UNION ALL SELECT DISTINCT {_block(2)}, 'pdf' FROM conversations UNION ALL SELECT DISTINCT {_block(3)}, 'xlsx' FROM conversations)""")

# --- Markdown facts ----------------------------------------------------------------------------
_SH, _PU = lit(SHIELDS), lit(PUNCTUATION)


def _piece(t, label=None):
    link = f" WHEN contains({t}, '](') THEN {label}" if label else ""
    return (f"CASE WHEN {matches(t, '^' + ESCAPE + '$')} THEN translate(substr({t}, 2, 1), {_PU}, {_SH})"
            f" WHEN {matches(t, f'(?s)^(?:{HTML}|{ENTITY})$')} THEN ''{link} ELSE {t} END")


def _assemble(x, var, label=None):
    return f"array_to_string(list_transform(regexp_extract_all({x}, {lit(TOKENS)}), lambda {var}: {_piece(var, label)}), '')"


def label_of(t):
    return f"regexp_replace(regexp_replace({t}, '^!?\\[', ''), {lit('(?s)\\]' + TARGET + '$')}, '')"


def _finish(x):
    for p in EMPHASIS:
        x = rr(x, p, r"\1\2")
    return f"translate({x}, {_SH}, {_PU})"


def inline(x):
    return f"CASE WHEN {matches(x, SPECIAL)} THEN {_finish(_assemble(x, 't', _assemble(label_of('t'), 'u')))} ELSE {x} END"


cte("md_lines", "arms", f"""
SELECT *, CASE WHEN NOT {matches('line', tx.NOT_WS)} THEN 'blank' WHEN {matches('line', mf.ATX)} THEN 'atx' WHEN {matches('line', mf.ITEM)} THEN 'item'
    WHEN contains(line, '|') AND NOT {matches('line', mf.DELIMITER)} AND {matches("lead(line, 1, '') OVER w", mf.DELIMITER)} AND contains(lead(line, 1, '') OVER w, '|') THEN 'head'
    ELSE 'plain' END AS lk, length({extract('line', '^([ \\t]*)', 1)}) AS indent, lag(line) OVER w AS prev
FROM (SELECT doc_id, arm, unnest(l) AS line, unnest(range(len(l))) AS no FROM (SELECT doc_id, arm, {split('markdown')} AS l FROM arms))
WINDOW w AS (PARTITION BY doc_id, arm ORDER BY no)""")
_far = "(PARTITION BY doc_id, arm ORDER BY no)"
cte("md_blocks", "md_lines", f"""
SELECT *, CASE WHEN b IN ('heading', 'row') THEN no WHEN b = 'item' THEN owner
    WHEN b = 'text' THEN last_value(CASE WHEN b = 'text' AND pb IS DISTINCT FROM 'text' THEN no END IGNORE NULLS) OVER {_far} END AS start
FROM (SELECT *, lag(b) OVER {_far} AS pb FROM (
  SELECT *, CASE WHEN lk = 'blank' THEN NULL WHEN lk = 'atx' THEN 'heading' WHEN tbl >= 0 AND no = tbl + 1 THEN NULL
      WHEN lk = 'head' OR (tbl >= 0 AND lk = 'plain') THEN 'row' WHEN lk = 'item' OR owner >= 0 THEN 'item' ELSE 'text' END AS b
  FROM (SELECT *, coalesce(last_value(CASE WHEN lk = 'head' THEN no WHEN lk <> 'plain' THEN -1 END IGNORE NULLS) OVER {_far}, -1) AS tbl,
      coalesce(last_value(CASE WHEN lk = 'item' THEN no WHEN indent < 2 AND (lk IN ('atx', 'head') OR (lk = 'plain' AND NOT coalesce({matches('prev', tx.NOT_WS)}, false))) THEN -1 END IGNORE NULLS) OVER {_far}, -1) AS owner
      FROM md_lines)))""")
_item_content = extract('line', mf.ITEM, 4)
cte("md_pieces", "md_blocks", f"""
SELECT doc_id, arm, start, tbl, b, col, raw, lvl FROM (
  SELECT doc_id, arm, start, any_value(tbl) AS tbl, any_value(b) AS b, 0 AS col,
      string_agg(trim(CASE WHEN b = 'heading' THEN {extract('line', mf.ATX, 2)} WHEN lk = 'item' THEN {_item_content} ELSE trim(line) END), chr(10) ORDER BY no) AS raw,
      max(CASE WHEN b = 'heading' THEN length({extract('line', mf.ATX, 1)}) WHEN lk = 'item' THEN indent // 2 END) AS lvl
  FROM md_blocks WHERE start IS NOT NULL AND b IN ('heading', 'item', 'text') GROUP BY doc_id, arm, start)
UNION ALL SELECT doc_id, arm, no, tbl, 'table', -1, NULL, NULL FROM md_blocks WHERE b = 'row' AND no = tbl
UNION ALL SELECT doc_id, arm, no, tbl, 'cell', i, replace(raw, '\\|', '|'), NULL FROM (
  SELECT doc_id, arm, no, tbl, unnest(c) AS raw, unnest(range(len(c))) AS i FROM (
    SELECT *, list_transform(string_split(regexp_replace(replace(trim(line), '\\|', chr(57599)), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(replace(x, chr(57599), '\\|'))) AS c
    FROM md_blocks WHERE b = 'row'))""")
cte("out_facts", "md_pieces", f"""
SELECT doc_id, arm, CASE kind WHEN 'HEADING' THEN 'heading:' || n WHEN 'TEXT_BLOCK' THEN 'text-block:' || n WHEN 'LIST_ITEM' THEN 'list-item:' || n
      WHEN 'TABLE' THEN 'table:' || tn WHEN 'TABLE_CELL' THEN 'table:' || tn || ':cell:' || rn || ':' || col ELSE 'link:' || n END AS fact_id,
    kind, text, ord, 'line:' || (start + 1) AS location, CASE WHEN kind IN ('HEADING', 'LIST_ITEM') THEN lvl::VARCHAR END AS level,
    CASE WHEN kind = 'TABLE_CELL' THEN rn::VARCHAR END AS row_no, CASE WHEN kind = 'TABLE_CELL' THEN col::VARCHAR END AS col_no, target,
    CASE WHEN kind = 'TABLE' THEN (max(rn) OVER t + 1)::VARCHAR END AS n_rows, CASE WHEN kind = 'TABLE' THEN (max(CASE WHEN kind = 'TABLE_CELL' THEN col END) OVER t + 1)::VARCHAR END AS n_cols
FROM (SELECT *, row_number() OVER o - 1 AS ord, row_number() OVER (PARTITION BY doc_id, arm, kind ORDER BY start, col, nth) AS n,
        sum(CASE WHEN kind = 'TABLE' THEN 1 ELSE 0 END) OVER o AS tn, start - tbl - CASE WHEN start > tbl THEN 1 ELSE 0 END AS rn
  FROM (SELECT doc_id, arm, start, tbl, col, 0 AS nth, lvl, NULL AS target, CASE b WHEN 'heading' THEN 'HEADING' WHEN 'item' THEN 'LIST_ITEM' WHEN 'text' THEN 'TEXT_BLOCK'
          WHEN 'table' THEN 'TABLE' ELSE 'TABLE_CELL' END AS kind, CASE WHEN b <> 'table' THEN {inline('raw')} END AS text FROM md_pieces
    UNION ALL SELECT doc_id, arm, start, tbl, col, nth, NULL, {rr(f"regexp_replace(regexp_replace(ref, {lit('(?s)^.*' + chr(92) + ']' + chr(92) + '(')}, ''), '\\)$', '')", r'\\([!-/:-@\[-`{-~])', r'\1')},
        'LINK', {_finish(_assemble(label_of('ref'), 'u'))} FROM (
      SELECT *, unnest(refs) AS ref, unnest(range(1, len(refs) + 1)) AS nth FROM (
        SELECT *, list_filter(regexp_extract_all(raw, {lit(TOKENS)}), lambda t: ends_with(t, ')') AND contains(t, '](')) AS refs FROM md_pieces WHERE contains(raw, ']('))))
  WINDOW o AS (PARTITION BY doc_id, arm ORDER BY start, col, nth))
WINDOW t AS (PARTITION BY doc_id, arm, tn)""")

# --- comparison --------------------------------------------------------------------------------
_content = f"kind IN ({', '.join(lit(k) for k in dims.CONTENT_KINDS)})"
_exact = "IN ('SOURCE_EXACT', 'DERIVED_EXACT')"
_place = "CASE WHEN kind IN ('HEADING', 'LIST_ITEM') THEN level WHEN kind = 'TABLE_CELL' THEN row_no || ',' || col_no END"
cte("cs", "src_facts", f"""
SELECT doc_id, fact_id, kind, ord, {norm('text')} AS norm, {_place} AS place, CASE WHEN kind = 'LINK' THEN {uri('target')} END AS uri,
    certainty {_exact} AS x_fact, coalesce(text_certainty, certainty) {_exact} AS x_text, certainty {_exact} AS x_order, certainty {_exact} AS x_target,
    certainty {_exact} AS x_presence, CASE WHEN kind IN ('HEADING', 'LIST_ITEM', 'TABLE_CELL') THEN certainty {_exact} AND {_place} IS NOT NULL ELSE false END AS x_place
FROM src_facts""")
cte("co", "out_facts", f"""
SELECT doc_id, arm, fact_id, kind, ord, {norm('text')} AS norm, {_place} AS place, CASE WHEN kind = 'LINK' THEN {uri('target')} END AS uri FROM out_facts""")
_items_of = lambda t, key, text_ok, target_ok: f"""
SELECT {key}, 'token' AS cls, unnest({tokens('norm')}) AS key FROM {t} WHERE {_content} AND {text_ok}
UNION ALL SELECT {key}, kind, norm FROM {t} WHERE kind IN ('HEADING', 'LIST_ITEM', 'TABLE_CELL', 'LINK') AND {text_ok} AND norm <> ''
UNION ALL SELECT {key}, 'uri', uri FROM {t} WHERE kind = 'LINK' AND {target_ok} AND uri <> ''"""
cte("si", "cs", f"SELECT doc_id, cls, key, count(*) AS n FROM ({_items_of('cs', 'doc_id', 'x_text', 'x_target')}) GROUP BY ALL")
cte("oi", "co", f"SELECT doc_id, arm, cls, key, count(*) AS n FROM ({_items_of('co', 'doc_id, arm', 'true', 'true')}) GROUP BY ALL")
cte("overlap", "si oi", "SELECT doc_id, oi.arm, cls, sum(least(si.n, oi.n))::BIGINT AS matched FROM oi JOIN si USING (doc_id, cls, key) GROUP BY ALL")
cte("fifo_o", "co", f"SELECT *, row_number() OVER (PARTITION BY doc_id, arm, kind, norm ORDER BY ord) AS rn FROM co WHERE norm <> ''")
_fifo_s = lambda ok: f"SELECT *, row_number() OVER (PARTITION BY doc_id, kind, norm ORDER BY ord) AS rn FROM cs WHERE norm <> '' AND {ok}"
cte("place_pairs", "cs fifo_o", f"""
SELECT o.doc_id, o.arm, o.kind, s.place IS NOT DISTINCT FROM o.place AS same FROM ({_fifo_s('x_place')}) s
JOIN fifo_o o ON s.doc_id = o.doc_id AND s.kind = o.kind AND s.norm = o.norm AND s.rn = o.rn""")
cte("anchors", "cs fifo_o", f"""
SELECT o.doc_id, o.arm, o.kind, s.ord AS so, o.ord AS oo FROM ({_fifo_s('x_order AND ' + _content)}) s
JOIN fifo_o o ON s.doc_id = o.doc_id AND s.kind = o.kind AND s.norm = o.norm AND s.rn = o.rn""")
cte("inv", "anchors", """
SELECT a.doc_id, a.arm, count(*) AS inversions FROM anchors a JOIN anchors b ON a.doc_id = b.doc_id AND a.arm = b.arm AND a.so < b.so AND a.oo > b.oo GROUP BY ALL""")
# Counts of a pair, written out: s_ and x-prefixed names count source facts, out_ names output facts.
_SOURCE = """
    count(*) AS s_all, count(*) FILTER (x_fact) AS s_fact, count(*) FILTER (x_presence) AS s_presence,
    count(*) FILTER (content) AS t_all, count(*) FILTER (content AND x_text) AS t_exact, count(*) FILTER (content AND norm <> '') AS t_said,
    count(*) FILTER (content AND norm <> '' AND x_text) AS t_said_exact, count(*) FILTER (content AND norm <> '' AND x_order) AS o_exact,
    count(*) FILTER (kind = 'HEADING') AS h_all, count(*) FILTER (kind = 'HEADING' AND x_text) AS h_exact, count(*) FILTER (kind = 'HEADING' AND x_place) AS h_place,
    count(*) FILTER (kind = 'LIST_ITEM') AS l_all, count(*) FILTER (kind = 'LIST_ITEM' AND x_text) AS l_exact, count(*) FILTER (kind = 'LIST_ITEM' AND x_place) AS l_place,
    count(*) FILTER (kind = 'TABLE_CELL') AS c_all, count(*) FILTER (kind = 'TABLE_CELL' AND x_text) AS c_exact, count(*) FILTER (kind = 'TABLE_CELL' AND x_place) AS c_place,
    count(*) FILTER (kind = 'TABLE') AS tab_all, count(*) FILTER (kind = 'TABLE' AND x_presence) AS tab_exact,
    count(*) FILTER (kind = 'IMAGE') AS img_all, count(*) FILTER (kind = 'IMAGE' AND x_presence) AS img_exact,
    count(*) FILTER (kind = 'LINK') AS lnk_all, count(*) FILTER (kind = 'LINK' AND x_target) AS lnk_exact, count(*) FILTER (kind = 'LINK' AND x_target AND uri <> '') AS uri_exact,
    count(*) FILTER (kind = 'LINK' AND norm <> '') AS anc_all, count(*) FILTER (kind = 'LINK' AND norm <> '' AND x_text) AS anc_exact"""
_OUTPUT = """
    count(*) AS out_all, count(*) FILTER (kind = 'TABLE') AS out_tab, count(*) FILTER (kind = 'IMAGE') AS out_img, count(*) FILTER (kind = 'LINK' AND uri <> '') AS out_uri,
    count(*) FILTER (kind = 'HEADING') AS out_h, count(*) FILTER (kind = 'LIST_ITEM') AS out_l, count(*) FILTER (kind = 'TABLE_CELL') AS out_c"""
_MATCHED = """
    sum(matched) FILTER (cls = 'token') AS m_token, sum(matched) FILTER (cls = 'uri') AS m_uri, sum(matched) FILTER (cls = 'LINK') AS m_anchor,
    sum(matched) FILTER (cls = 'HEADING') AS m_h, sum(matched) FILTER (cls = 'LIST_ITEM') AS m_l, sum(matched) FILTER (cls = 'TABLE_CELL') AS m_c"""
_PLACED = """
    count(*) FILTER (kind = 'HEADING') AS p_h, count(*) FILTER (kind = 'HEADING' AND same) AS e_h, count(*) FILTER (kind = 'LIST_ITEM') AS p_l,
    count(*) FILTER (kind = 'LIST_ITEM' AND same) AS e_l, count(*) FILTER (kind = 'TABLE_CELL') AS p_c, count(*) FILTER (kind = 'TABLE_CELL' AND same) AS e_c"""
_NAMES = re.findall(r" AS (\w+)", _SOURCE + _OUTPUT + _MATCHED + _PLACED) + ["src_tokens", "out_tokens", "anchors", "inversions"]
cte("wide", "pairs cs co overlap place_pairs anchors inv", f"""
SELECT p.*, {", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in _NAMES)}
FROM pairs p
LEFT JOIN (SELECT doc_id, sum(len({tokens('norm')})) FILTER (content AND x_text) AS src_tokens, {_SOURCE} FROM (SELECT *, {_content} AS content FROM cs) GROUP BY doc_id) s ON s.doc_id = p.doc_id
LEFT JOIN (SELECT doc_id, arm, sum(len({tokens('norm')})) FILTER ({_content}) AS out_tokens, {_OUTPUT} FROM co GROUP BY ALL) o ON o.doc_id = p.doc_id AND o.arm = p.arm
LEFT JOIN (SELECT doc_id, arm, {_MATCHED} FROM overlap GROUP BY ALL) m ON m.doc_id = p.doc_id AND m.arm = p.arm
LEFT JOIN (SELECT doc_id, arm, {_PLACED} FROM place_pairs GROUP BY ALL) g ON g.doc_id = p.doc_id AND g.arm = p.arm
LEFT JOIN (SELECT doc_id, arm, count(*) AS anchors FROM anchors GROUP BY ALL) a ON a.doc_id = p.doc_id AND a.arm = p.arm
LEFT JOIN inv i ON i.doc_id = p.doc_id AND i.arm = p.arm""")

# Metrics, written out: name, method, why it is not evaluated (first reason that holds), numerator, denominator.
_SURE = "'NOT_EVALUATED_SOURCE_CERTAINTY'"
_METRICS = [
    ("evaluation_coverage_exact", "source_fact_certainty_coverage", "NULL", "s_fact", "s_all"),
    ("text_recall", "unicode_nfc_case_sensitive_token_multiset", f"CASE WHEN t_all > 0 AND t_exact = 0 THEN {_SURE} END", "m_token", "src_tokens"),
    ("text_precision", "unicode_nfc_case_sensitive_token_multiset", f"CASE WHEN t_exact < t_all THEN {_SURE} END", "m_token", "out_tokens"),
    ("heading_recall", "exact_normalized_text_one_to_one", f"CASE WHEN h_all > 0 AND h_exact = 0 THEN {_SURE} END", "m_h", "h_exact"),
    ("heading_precision", "exact_normalized_text_one_to_one", f"CASE WHEN h_exact < h_all THEN {_SURE} END", "m_h", "out_h"),
    ("heading_level_accuracy", "matched_heading_exact_level",
     "CASE WHEN h_all = 0 THEN 'NOT_APPLICABLE' WHEN h_place = 0 THEN 'NOT_EVALUATED_SOURCE_EVIDENCE' WHEN p_h = 0 THEN 'NOT_EVALUATED_NO_MATCHED_FACTS' END", "e_h", "p_h"),
    ("list_item_recall", "exact_normalized_text_one_to_one", f"CASE WHEN l_all > 0 AND l_exact = 0 THEN {_SURE} END", "m_l", "l_exact"),
    ("list_item_precision", "exact_normalized_text_one_to_one", f"CASE WHEN l_exact < l_all THEN {_SURE} END", "m_l", "out_l"),
    ("list_level_accuracy", "matched_list_item_exact_level",
     "CASE WHEN l_all = 0 THEN 'NOT_APPLICABLE' WHEN l_place = 0 THEN 'NOT_EVALUATED_SOURCE_EVIDENCE' WHEN p_l = 0 THEN 'NOT_EVALUATED_NO_MATCHED_FACTS' END", "e_l", "p_l"),
    ("table_count_recall", "count_only_v0_2", f"CASE WHEN tab_all > 0 AND tab_exact = 0 THEN {_SURE} END", "least(tab_exact, out_tab)", "tab_exact"),
    ("table_count_precision", "count_only_v0_2", f"CASE WHEN tab_exact < tab_all THEN {_SURE} END", "least(tab_exact, out_tab)", "out_tab"),
    ("table_cell_recall", "exact_normalized_text_one_to_one", f"CASE WHEN c_all > 0 AND c_exact = 0 THEN {_SURE} END", "m_c", "c_exact"),
    ("table_cell_precision", "exact_normalized_text_one_to_one", f"CASE WHEN c_exact < c_all THEN {_SURE} END", "m_c", "out_c"),
    ("table_cell_position_accuracy", "matched_cell_exact_row_column",
     "CASE WHEN c_all = 0 THEN 'NOT_APPLICABLE' WHEN c_place = 0 THEN 'NOT_EVALUATED_SOURCE_EVIDENCE' WHEN p_c = 0 THEN 'NOT_EVALUATED_NO_MATCHED_FACTS' END", "e_c", "p_c"),
    ("link_target_recall", "canonical_uri_multiset", f"CASE WHEN lnk_all > 0 AND lnk_exact = 0 THEN {_SURE} END", "m_uri", "uri_exact"),
    ("link_target_precision", "canonical_uri_multiset", f"CASE WHEN lnk_exact < lnk_all THEN {_SURE} END", "m_uri", "out_uri"),
    ("link_anchor_text_recall", "exact_normalized_anchor_text", f"CASE WHEN anc_all > 0 AND anc_exact = 0 THEN {_SURE} END", "m_anchor", "anc_exact"),
    ("image_reference_count_recall", "count_only_v0_3", f"CASE WHEN img_all > 0 AND img_exact = 0 THEN {_SURE} END", "least(img_exact, out_img)", "img_exact"),
    ("image_reference_count_precision", "count_only_v0_3", f"CASE WHEN img_exact < img_all THEN {_SURE} END", "least(img_exact, out_img)", "out_img"),
    ("output_nonempty", "source_aware_markdown_semantic_fact_presence", f"CASE WHEN s_all = 0 THEN 'NOT_APPLICABLE' WHEN s_presence = 0 THEN {_SURE} END", "CASE WHEN out_all > 0 THEN 1 ELSE 0 END", "1"),
    ("content_token_length_ratio", "output_content_tokens/source_content_tokens", f"CASE WHEN t_said_exact < t_said THEN {_SURE} END", "out_tokens", "src_tokens"),
    ("order_anchor_coverage", "exact_kind_text_anchor", f"CASE WHEN t_said = 0 THEN 'NOT_APPLICABLE' WHEN o_exact = 0 THEN {_SURE} END", "anchors", "o_exact"),
    ("pairwise_order_accuracy", "pairwise_relative_order",
     f"CASE WHEN t_said < 2 THEN 'NOT_APPLICABLE' WHEN o_exact < 2 THEN {_SURE} WHEN anchors < 2 THEN 'NOT_EVALUATED_INSUFFICIENT_ANCHORS' END",
     "anchors * (anchors - 1) // 2 - inversions", "anchors * (anchors - 1) // 2"),
]
cte("metrics", "wide", "\nUNION ALL ".join(f"""
SELECT doc_id, format, arm, '{name}' AS name, coalesce(refused, CASE WHEN den = 0 THEN 'NOT_APPLICABLE' ELSE 'EVALUATED' END) AS status,
  CASE WHEN refused IS NULL AND den <> 0 THEN num::DOUBLE / den END AS value, CASE WHEN refused IS NULL THEN num ELSE 0 END AS numerator,
  CASE WHEN refused IS NULL THEN den ELSE 0 END AS denominator, '{method}' AS method
FROM (SELECT doc_id, format, arm, {refused}::VARCHAR AS refused, ({num})::BIGINT AS num, ({den})::BIGINT AS den FROM wide)""" for name, method, refused, num, den in _METRICS)
    + f"""
UNION ALL SELECT doc_id, format, arm, 'duplicate_or_extra_content_count', CASE WHEN t_said_exact < t_said THEN {_SURE} ELSE 'EVALUATED' END,
  CASE WHEN t_said_exact >= t_said THEN (out_tokens - m_token)::DOUBLE END, CASE WHEN t_said_exact >= t_said THEN out_tokens - m_token ELSE 0 END,
  CASE WHEN t_said_exact >= t_said THEN out_tokens ELSE 0 END, 'token_multiset_excess_count' FROM wide""")
cte("findings", "wide cs co pairs", f"""
SELECT doc_id, format, arm, 'EMPTY_OUTPUT' AS code, 'error' AS severity, NULL AS source_fact_id FROM wide WHERE s_presence > 0 AND out_all = 0
UNION ALL SELECT doc_id, format, arm, 'EXTRA_OR_DUPLICATED_CONTENT', 'warning', NULL FROM wide WHERE t_said_exact = t_said AND out_tokens > m_token
UNION ALL SELECT doc_id, format, arm, 'MISSING_IMAGE_REFERENCE', 'warning', NULL FROM wide WHERE img_exact > out_img
UNION ALL SELECT p.doc_id, format, p.arm, 'MISSING_' || s.kind, 'warning', s.fact_id FROM pairs p JOIN (
    SELECT doc_id, kind, norm, fact_id, row_number() OVER (PARTITION BY doc_id, kind, norm ORDER BY ord) AS rn FROM cs
    WHERE x_text AND kind IN ('HEADING', 'LIST_ITEM', 'TABLE_CELL')) s ON s.doc_id = p.doc_id
  LEFT JOIN (SELECT doc_id, arm, kind, norm, count(*) AS n FROM co WHERE norm <> '' GROUP BY ALL) o
  ON o.doc_id = p.doc_id AND o.arm = p.arm AND o.kind = s.kind AND o.norm = s.norm WHERE s.rn > coalesce(o.n, 0)
UNION ALL SELECT p.doc_id, format, p.arm, 'MISSING_LINK_TARGET', 'warning', s.fact_id FROM pairs p JOIN (
    SELECT doc_id, uri, fact_id, row_number() OVER (PARTITION BY doc_id, uri ORDER BY ord) AS rn FROM cs
    WHERE x_target AND kind = 'LINK' AND uri <> '') s ON s.doc_id = p.doc_id
  LEFT JOIN (SELECT doc_id, arm, uri, count(*) AS n FROM co WHERE kind = 'LINK' AND uri <> '' GROUP BY ALL) o
  ON o.doc_id = p.doc_id AND o.arm = p.arm AND o.uri = s.uri WHERE s.rn > coalesce(o.n, 0)""")

# --- scores ------------------------------------------------------------------------------------
_FAMILIES = """
    ('text', t_all, t_exact), ('extra_content', t_all, t_exact), ('headings', h_all, h_exact), ('extra_headings', h_all, h_exact), ('heading_hierarchy', h_all, h_place),
    ('lists', l_all, l_exact), ('extra_lists', l_all, l_exact), ('list_hierarchy', l_all, l_place), ('tables', c_all, c_exact), ('extra_tables', c_all, c_exact),
    ('table_geometry', c_all, c_place), ('links', lnk_all, lnk_exact), ('extra_links', lnk_all, lnk_exact), ('images', img_all, img_exact), ('extra_images', img_all, img_exact),
    ('reading_order', t_said * (t_said - 1) // 2, o_exact * (o_exact - 1) // 2)"""
cte("opportunities", "wide dim_score_families", f"""
SELECT w.doc_id, w.format, w.arm, o.family, o.n_source::BIGINT AS source_opportunities, o.n_evaluable::BIGINT AS evaluable_opportunities, dimension, primary_metric
FROM wide w, LATERAL (VALUES {_FAMILIES}) AS o(family, n_source, n_evaluable) JOIN dim_score_families d ON d.family = o.family""")
_ok = "(m.status = 'EVALUATED' AND m.value BETWEEN 0 AND 1)"
cte("families", "opportunities metrics", f"""
SELECT doc_id, format, arm, dimension, family, status, CASE WHEN status = 'EVALUATED' THEN value * 100 END AS score,
    CASE WHEN status <> 'EVALUATED' THEN 0.0::DOUBLE WHEN source_opportunities = 0 THEN 100.0::DOUBLE ELSE evaluable_opportunities::DOUBLE * 100 / source_opportunities END AS coverage,
    primary_metric, source_opportunities, evaluable_opportunities
FROM (SELECT o.*, m.value, CASE
    WHEN source_opportunities = 0 THEN CASE WHEN dimension = 'noise' AND coalesce({_ok}, false) AND m.denominator > 0 THEN 'EVALUATED' ELSE 'NOT_APPLICABLE' END
    WHEN evaluable_opportunities = 0 THEN 'NOT_EVALUATED_SOURCE_CERTAINTY' WHEN NOT coalesce({_ok}, false) THEN 'NOT_EVALUATED' ELSE 'EVALUATED' END AS status
  FROM opportunities o LEFT JOIN metrics m ON m.doc_id = o.doc_id AND m.arm = o.arm AND m.name = o.primary_metric)""")
_gap = "(status <> 'EVALUATED' OR (source_opportunities > 0 AND evaluable_opportunities < source_opportunities))"
cte("dimensions", "families", f"""
SELECT doc_id, format, arm, dimension, CASE WHEN af = 0 THEN 'NOT_APPLICABLE' WHEN ef = 0 THEN 'NOT_EVALUATED' WHEN gap THEN 'PARTIAL_EVIDENCE' ELSE 'EVALUATED' END AS status,
    score, coverage, af AS applicable_families, ef AS evaluated_families
FROM (SELECT doc_id, format, arm, dimension, count(*) FILTER (status <> 'NOT_APPLICABLE') AS af, count(*) FILTER (status = 'EVALUATED') AS ef,
    coalesce(avg(coverage) FILTER (status <> 'NOT_APPLICABLE'), 0) AS coverage, round_even(avg(score) FILTER (status = 'EVALUATED'), 1) AS score,
    bool_or(status <> 'NOT_APPLICABLE' AND {_gap}) AS gap FROM families GROUP BY ALL)""")
cte("doc_scores", "dimensions families metrics", f"""
SELECT *, CASE status WHEN 'SCORED' THEN 'ELIGIBLE_DOCUMENT_LEVEL' WHEN 'PARTIAL_EVIDENCE' THEN 'NOT_ELIGIBLE_PARTIAL_EVIDENCE' ELSE 'NOT_ELIGIBLE' END AS eligibility,
    '{dims.METHODOLOGY_VERSION}' AS methodology_version, '{dims.TARGET_PROFILE}' AS target_profile
FROM (SELECT doc_id, format, arm, base_quality, integrity, score, CASE WHEN score IS NULL THEN 'NOT_EVALUATED' WHEN gap THEN 'PARTIAL_EVIDENCE' ELSE 'SCORED' END AS status
  FROM (SELECT b.doc_id, b.format, b.arm, base_quality, integrity, gap,
      CASE WHEN base_quality IS NOT NULL AND integrity IS NOT NULL THEN round_even(least(base_quality, integrity), 1) END AS score
    FROM (SELECT doc_id, format, arm, round_even(sum(score::DECIMAL(20, 10))::DOUBLE / count(score), 1) AS base_quality FROM dimensions GROUP BY ALL) b
    JOIN (SELECT doc_id, arm, bool_or(status <> 'NOT_APPLICABLE' AND {_gap}) AS gap FROM families GROUP BY ALL) g ON g.doc_id = b.doc_id AND g.arm = b.arm
    LEFT JOIN (SELECT doc_id, arm, round_even(min(least(1, value) * 100), 1) AS integrity FROM metrics
               WHERE name IN ('output_nonempty', 'content_token_length_ratio') AND status = 'EVALUATED' GROUP BY ALL) i ON i.doc_id = b.doc_id AND i.arm = b.arm))""")
