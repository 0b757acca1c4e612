"""Column functions on text: whitespace, tokens, Markdown and HTML escapes, code delimiters."""
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values: character classes, spelled so that Java and RE2 read them alike -------------
WS = r"[\t-\r\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x{85}\p{Z}]"
WS_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = (r"\p{L}[\p{L}\p{M}\p{N}'’\-]*|\p{N}+(?:[.,]\p{N}+)?|" + NOT_WS)
# Everything below this range is composed already; the test is cheap.
BEYOND_LATIN = r"[^\x{00}-\x{2FF}]"
# Text that may change under canonical composition: combining marks, conjoining jamo, and the
# characters with a canonical singleton or excluded decomposition.
MAYBE_NOT_NFC = (r"[\p{M}\x{1100}-\x{11FF}\x{340}\x{341}\x{374}\x{37E}\x{387}\x{958}-\x{95F}"
                 r"\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}"
                 r"\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]")


def let(value: Column, body) -> Column:
    """Bind an expression to a name, so that a large one is planned and evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, step, out, out_type: str, piece: int = 256) -> Column:
    """``out(state, x)`` of every item, with the state that ``step`` folds from left to right.

    Appending to a growing array copies it, so results grow in pieces: a list of n items costs about
    n * piece / 2 copies instead of n * n / 2.
    """
    count = F.size(items)
    cuts = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / piece).cast("int"))).otherwise(F.array().cast("array<int>"))
    pieces = let(items, lambda xs: F.transform(cuts, lambda k: F.slice(xs, k * piece + 1, F.lit(piece))))
    empty = F.array().cast(f"array<{out_type}>")

    def one(acc, x):
        return F.struct(step(acc["state"], x).alias("state"), F.array_append(acc["out"], out(acc["state"], x)).alias("out"))

    def whole(acc, xs):
        return let(F.aggregate(xs, F.struct(acc["state"].alias("state"), empty.alias("out")), one),
                   lambda done: F.struct(done["state"].alias("state"), F.array_append(acc["out"], done["out"]).alias("out")))

    begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
    return F.flatten(F.aggregate(pieces, begin, whole)["out"])



@F.pandas_udf(StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition; only text that may need it is sent to the Arrow worker."""
    maybe = text.rlike(BEYOND_LATIN) & text.rlike(MAYBE_NOT_NFC)
    return F.coalesce(_compose(F.when(maybe, text)), text)


def trim_ws(text: Column) -> Column:
    """Only the ends are looked at, however much white space a text holds."""
    return F.btrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(NOT_WS), F.lit(True))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " "))


def normalize_text(text: Column) -> Column:
    """Null and blank become '', the rest is NFC with single spaces."""
    return collapse_ws(nfc(text))


_RUNS, _UNEVEN = re.compile(f"[{WS_CHARS}]+"), re.compile(f"[{WS_CHARS.replace(' ', '')}]|  ")


def collapsed(text: str) -> str:
    """``collapse_ws`` of one text; most have single spaces already."""
    return (_RUNS.sub(" ", text) if _UNEVEN.search(text) else text).strip(" ")


def _normal_lines(texts: pa.Array) -> pa.Array:
    norms, lines = [], []
    for t in texts.to_pylist():
        t = unicodedata.normalize("NFC", (t or b"").decode("utf-8", "surrogateescape"))
        own = None
        if "\n" in t:
            own = [x.encode("utf-8", "surrogateescape") for x in map(collapsed, t.split("\n")) if x]
        norms.append(collapsed(t).encode("utf-8", "surrogateescape"))
        lines.append(own)
    return pa.StructArray.from_arrays([pa.array(norms, pa.binary()), pa.array(lines, pa.list_(pa.binary()))], names=["norm", "lines"])


def normal_lines(text: Column) -> Column:
    """``normalize_text`` of a text, and of its lines where it has several, as bytes.

    Said to be not deterministic, or the planner would put it into every filter and column that reads it and run it once for each.
    """
    return F.arrow_udf(_normal_lines, "struct<norm:binary,lines:array<binary>>").asNondeterministic()(text.cast("binary"))


def tokens(normalized: Column) -> Column:
    """Token array of an already normalised text."""
    return F.regexp_extract_all(normalized, F.lit(TOKEN), F.lit(0))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                        ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def escape_markdown(text: Column) -> Column:
    """Inline specials everywhere, block markers at the start of a line."""
    indent = r"(?md)^([\t\x{0B}-\r\x{85}\p{Z}]*)"
    text = F.regexp_replace(text, r"([\\*_`\[\]<])", r"\\$1")
    text = F.regexp_replace(text, indent + r"([#>]|- |\+ |---)", r"$1\\$2")
    return F.regexp_replace(text, indent + r"([0-9]{1,9})([.)] )", r"$1$2\\$3")


def escape_link_label(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]])", r"\\$1")


def longest_backtick_run(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit("`+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def code_span(text: Column) -> Column:
    fence = F.repeat(F.lit("`"), longest_backtick_run(text) + 1)
    pad = F.when(text.startswith("`") | text.endswith("`"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(fence, pad, text, pad, fence)


def fence_of(text: Column) -> Column:
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_backtick_run(text) + 1))


def clean_language(lang: Column) -> Column:
    return F.regexp_replace(F.coalesce(lang, F.lit("")),
                            r"[\x{00}-\x{1F}\x{7F}`\x{85}\p{Z}]", "")


def code_fence(text: Column, lang: Column) -> Column:
    fence = fence_of(text)
    newline = F.when(text.endswith("\n"), F.lit("")).otherwise(F.lit("\n"))
    return F.concat(fence, clean_language(lang), F.lit("\n"), text, newline, fence)


def json_markdown(name: Column, json_text: Column) -> Column:
    fence = fence_of(json_text)
    return F.concat(F.lit("# "), name, F.lit("\n\n"), fence, F.lit("json\n"), json_text,
                    F.lit("\n"), fence, F.lit("\n"))


def strip_heading_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?md)^#+" + WS + "*", "")


SHORT = 1 << 20          # cells of the edit table that the JVM's own function fills


def banded_distance(a: str, b: str, k: int) -> int:
    """Edit distance of ``a`` and ``b`` if it is ``k`` or less, else something greater.

    One column of the edit table per character of ``b``, as two bit strings of vertical steps, and of
    it only the 2k + 1 rows around the diagonal; the window moves down by a row with every column.
    ``a`` is the longer one, or as long.
    """
    m, n, width = len(a), len(b), 2 * k + 1
    ones, top = (1 << width) - 1, 1 << width - 1
    where = {}
    for i, c in enumerate(a):
        where.setdefault(c, []).append(i)
    match = {}
    for c in set(b) & set(where):
        bits = bytearray(m + 8 >> 3)
        for i in where[c]:
            bits[i >> 3] |= 1 << (i & 7)
        match[c] = int.from_bytes(bits, "little")
    up, down = ones & ~((1 << k) - 1), 0       # steps of +1 and -1 from a row to the next
    score = min(k, m)                          # at the window's last row, or the table's
    for j in range(1, n + 1):
        first = j - k - 1                      # row of the table, from 0, at bit 0
        held = match.get(b[j - 1], 0)
        x = (held >> first if first >= 0 else held << -first) & ones
        diagonal = ((((x & up) + up) ^ up) | x | down) & ones
        right = (down | ~(diagonal | up)) & ones
        left = diagonal & up
        below = j + k - m                      # rows of the window behind the end of ``a``
        if below <= 0:
            score += not diagonal & top
        else:
            bit = top >> below
            score += bool(right & bit) - bool(left & bit)
        moved = diagonal >> 1
        up, down = (left | ~(moved | right)) & ones, moved & right
    return score


def edit_distance(a: str, b: str) -> int:
    """Exact edit distance: the band grows until the distance fits in it."""
    if len(a) < len(b):
        a, b = b, a
    begin = 0
    while begin < len(b) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < len(b) - begin and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[begin:len(a) - end], b[begin:len(b) - end]
    if not b:
        return len(a)
    k = max(len(a) - len(b), 32)
    while True:
        found = banded_distance(a, b, k)
        if found <= k or k >= len(a):
            return found
        k = min(2 * k, len(a))


def edits(want: Column, got: Column) -> Column:
    """Edit distance of two texts. Only long pairs, whose table the JVM would fill cell by cell, go to Arrow workers."""
    @F.pandas_udf("bigint")
    def far(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int64")

    long = F.length(want).cast("bigint") * F.length(got) > SHORT
    return F.coalesce(F.when(~long, F.levenshtein(want, got).cast("bigint")), far(F.when(long, want), F.when(long, got)))


def character_errors(expected: Column, actual: Column) -> dict[str, Column]:
    """Edit-distance figures of an extracted text against its ground truth."""
    want, got = collapse_ws(expected), collapse_ws(strip_heading_marks(actual))
    errors = edits(want, got)
    n = F.length(want).cast("bigint")
    cer = F.when(n > 0, errors / n).otherwise(F.lit(0.0))
    recall = F.when(n > 0, (n - errors) / n * 100.0).otherwise(F.lit(0.0))
    words = lambda t: F.size(F.regexp_extract_all(t, F.lit(NOT_WS + "+"), F.lit(0)))
    return {
        "exact_match": want == got,
        "character_errors": errors,
        "cer_percent": F.bround(cer * 100.0, 2),
        "recall_percent": F.bround(recall, 2),
        "accuracy_percent": F.bround((F.lit(1.0) - cer) * 100.0, 2),
        "word_count_match": words(want) == words(got),
    }
