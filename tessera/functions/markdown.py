"""Column functions on Markdown inline text.

Dialect: backslash escapes, code spans, links, images (also inside a link), emphasis, strike;
reference links and images (full, collapsed, shortcut) where the caller gives their definitions, and
bare links. Inline HTML, autolinks in angle brackets and entities yield no text.
"""
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# --- fixed values: ASCII punctuation and the private-use characters that shield it -------------
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHIELDS = "".join(chr(0xE000 + i) for i in range(len(PUNCTUATION)))

ESCAPE = r"\\[!-/:-@\[-`{-~]"
# Repeats are possessive: Java would otherwise recurse once per character. No alternative of a repeat
# can begin where what follows the repeat begins, so nothing is lost.
LABEL = r"(?:[^\[\]\\]++|\\.)*+"
TARGET = r"\((?:[^()\s\\]++|\\.|\([^()\s]*+\))*+(?:\s++\"[^\"]*+\")?+\)"
IMAGE = rf"!\[{LABEL}\]{TARGET}"
LINK = rf"\[(?:[^\[\]\\!]++|\\.|!\[{LABEL}\]{TARGET}|!)*+\]{TARGET}"
CODE = r"````[^`]++````|```[^`]++```|``(?:[^`]++|`(?!`))++``|`[^`]++`"
HTML = r"<[A-Za-z/!?][^<>]*>"
ENTITY = r"&[A-Za-z][A-Za-z0-9]+;|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
TOKENS = rf"(?s){ESCAPE}|{CODE}|{IMAGE}|{LINK}|{HTML}|{ENTITY}|[^\\`!\[<&]+|."
SPECIAL = r"[\\`!\[<&*_~]"

# --- references and bare links -------------------------------------------------------------------
TITLE = r"(?:\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'|\((?:[^()\\]++|\\.)*+\))"
DEFINITION = rf"^ {{0,3}}\[(?!\^)({LABEL})\]:[ \t]*(<[^<>]*>|[^\s<]\S*)(?:[ \t]+({TITLE}))?[ \t]*$"
TITLE_LINE = rf"^[ \t]*({TITLE})[ \t]*$"
MAY_DEFINE = r"(?m)^[ \t>]*\[[^\]]+\]:"
# A bracket group may be a reference; whether it is one depends on the document's definitions.
_INSIDE = rf"(?:[^\[\]\\!]++|\\.|!\[{LABEL}\](?:{TARGET}|\[{LABEL}\])?+|!)*+"
GROUP = rf"!?\[{_INSIDE}\]"
# A bare link stops before white space, "<", an entity, a closing bracket it did not open and
# punctuation at its end.
_HEAD = r"(?:(?:h(?i:ttps?)|f(?i:tp))://|m(?i:ailto):|t(?i:el):|w(?i:ww)\.)"
_LAST = r"(?![*_~]+(?:[\s<]|$)|[?!.,:](?:[\s<]|$))"
URL = rf"{_HEAD}(?:{_LAST}(?:(?!{ENTITY})[^\s<()]|\((?:[^\s<()]|\([^\s<()]*+\))*+\)|\())*+"
_HOST = r"(?:[\p{L}\p{N}_\-]+\.)*[\p{L}\p{N}\-]+\.[\p{L}\p{N}\-]+(?:[/?#:].*)?$"
VALID_URL = rf"(?is)^(?:(?:https?|ftp)://{_HOST}|www\.{_HOST}|mailto:[^@\s]+@{_HOST}|tel:.*[0-9])"
URL_HINTS = ("://", "www.", "mailto:", "tel:")
RICH_TOKENS = (rf"(?s){ESCAPE}|{CODE}|{IMAGE}|\[{_INSIDE}\]{TARGET}|{GROUP}|{HTML}|{ENTITY}|(?<![^\s*_~(]){URL}"
               rf"|(?:[^\\`!\[\]<&hfmtw]++|(?!(?<![^\s*_~(]){_HEAD})[hfmtw])++|.")

# An opening run needs text to its right and, before punctuation, a break to its left. Passes run
# from the inside out, so two of them resolve emphasis inside emphasis.
_STAR = r"(^|[^\p{L}\p{N}*])\*{1,3}([^\s*](?:[^*]*[^\s*])?)\*{1,3}"
_INWORD = r"()\*{1,3}([\p{L}\p{N}](?:[^*]*[^\s*])?)\*{1,3}"
_UNDERSCORE = r"(^|[^\p{L}\p{N}_])_{1,3}([^\s_](?:[^_]*[^\s_])?)_{1,3}"
_STRIKE = r"(^|[^~])~~([^\s~](?:[^~]*[^\s~])?)~~"
_EMPHASIS = (_STAR, _STAR, _INWORD, _UNDERSCORE, _UNDERSCORE, _STRIKE)


def inline_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def label_of(token: Column) -> Column:
    body = F.regexp_replace(token, r"^!?\[", "")
    return F.regexp_replace(body, rf"(?s)\]{TARGET}$", "")


def _shield(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, SHIELDS)


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([!-/:-@\[-`{-~])", "$1")


def target_of(token: Column) -> Column:
    inner = F.regexp_extract(token, rf"(?s)\]({TARGET})$", 1)
    url = F.regexp_extract(inner, r"(?s)^\((\S*?)(?:\s+\"[^\"]*\")?\)$", 1)
    return _unescape(url)


def title_of(token: Column) -> Column:
    return F.regexp_extract(token, r"(?s)\s+\"([^\"]*)\"\)$", 1)


def _code_text(token: Column) -> Column:
    body = F.regexp_replace(token, "^`+|`+$", "")
    padded = body.rlike(r"(?s)^ .*[^ ].* $")
    return F.when(padded, F.substring(body, F.lit(2), F.length(body) - 2)).otherwise(body)


def _piece(token: Column, label=None) -> Column:
    piece = (F.when(token.rlike(rf"^{ESCAPE}$"), _shield(F.substring(token, 2, 1)))
             .when(token.rlike("(?s)^`.+`$"), _shield(_code_text(token)))
             .when(token.rlike(rf"(?s)^(?:{HTML}|{ENTITY})$"), F.lit("")))
    if label is not None:
        piece = piece.when(token.contains("]("), label(label_of(token)))
    return piece.otherwise(token)


def _assemble(text: Column, label=None) -> Column:
    return F.array_join(F.transform(inline_tokens(text), lambda t: _piece(t, label)), "")


def _finish(shielded: Column) -> Column:
    for pattern in _EMPHASIS:
        shielded = F.regexp_replace(shielded, pattern, "$1$2")
    return F.translate(shielded, SHIELDS, PUNCTUATION)


def _label(text: Column) -> Column:
    """Label of a link: an image in it counts with its alternative text."""
    return F.when(text.rlike(SPECIAL), _assemble(F.regexp_replace(
        text, rf"!\[({LABEL}){'\\]'}{TARGET}", "$1"))).otherwise(text)


def inline_text(text: Column) -> Column:
    """Visible text of inline Markdown; plain text skips the token pass."""
    return F.when(text.rlike(SPECIAL), _finish(_assemble(text, _label))).otherwise(text)


def label_text(token: Column) -> Column:
    label = label_of(token)
    return F.when(label.rlike(SPECIAL), _finish(_label(label))).otherwise(label)


def references(text: Column) -> Column:
    """Link and image tokens in reading order; an image inside a link follows it."""
    found = F.filter(inline_tokens(text), lambda t: t.endswith(")") & t.contains("]("))
    inner = rf"(?s){ESCAPE}|{CODE}|{IMAGE}|."
    nested = F.transform(found, lambda t: F.concat(F.array(t), F.filter(
        F.regexp_extract_all(F.substring(t, F.lit(2), F.length(t)), F.lit(inner), F.lit(0)),
        lambda i: t.startswith("[") & (F.length(i) > 4) & i.startswith("!["))))
    return F.when(text.contains("]("), F.flatten(nested)).otherwise(F.array().cast("array<string>"))


# --- rich inlines: references resolved, bare links found ------------------------------------------
ITEM = "struct<kind:string,text:string,target:string,title:string,shown:boolean>"
DEFINED = "map<string,struct<target:string,title:string>>"


def label_key(label: Column) -> Column:
    """Labels are equal without case and with white space collapsed; their escapes stay."""
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def label_keys(text: Column) -> Column:
    """Distinct keys of all bracket groups that can name a definition."""
    groups = F.regexp_extract_all(text, F.lit(rf"(?s)\[({LABEL})\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(groups, label_key), lambda k: k != ""))


def definition_of(line: Column, after: Column) -> Column:
    """Key, target and title of a definition line; its title may stand on the line ``after``."""
    part = lambda i: F.regexp_extract(line, DEFINITION, i)
    target = F.regexp_replace(part(2), r"^<(.*)>$", "$1")
    title = F.when(part(3) != "", part(3)).otherwise(F.regexp_extract(F.coalesce(after, F.lit("")), TITLE_LINE, 1))
    bare = F.substring(title, F.lit(2), F.length(title) - 2)
    return F.struct(label_key(part(1)).alias("key"), _unescape(target).alias("target"), _unescape(bare).alias("title"))


def _item(kind: str, text: Column, target: Column = None, title: Column = None, shown: bool = True) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (none if target is None else target).alias("target"),
                    (none if title is None else title).alias("title"), F.lit(shown).alias("shown")).cast(ITEM)


def _inner_of(group: Column) -> Column:
    return F.regexp_replace(group, r"(?s)^!?\[(.*)\]$", "$1")


def _image_tokens(label: Column) -> Column:
    """Images of a label, inline or by reference."""
    found = F.regexp_extract_all(label, F.lit(rf"(?s){ESCAPE}|{CODE}|{IMAGE}|!\[{LABEL}\](?:\[{LABEL}\])?+|."), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 3) & t.startswith("!["))


def _image_reference(token: Column, defined: Column) -> Column:
    """Target and title of an image token, null where no definition has its label."""
    first = F.regexp_extract(token, rf"(?s)^!\[({LABEL})\]", 1)
    second = F.regexp_extract(token, rf"(?s)^!\[{LABEL}\]\[({LABEL})\]$", 1)
    key = label_key(F.when(second != "", second).otherwise(first))
    inline = F.struct(target_of(token).alias("target"), title_of(token).alias("title"))
    return F.when(token.endswith(")"), inline).otherwise(F.try_element_at(defined, key))


def _rich_label(label: Column, defined: Column) -> Column:
    """Text of a label: its images count with their alternative texts."""
    swapped = tx.let(label, lambda l: F.aggregate(
        F.filter(_image_tokens(l), lambda t: _image_reference(t, defined).isNotNull()), l,
        lambda text, t: F.replace(text, t, F.regexp_extract(t, rf"(?s)^!\[({LABEL})\]", 1))))
    return F.when(label.rlike(SPECIAL), _assemble(swapped)).otherwise(label)


def _images_in(label: Column, defined: Column) -> Column:
    known = F.filter(_image_tokens(label), lambda t: _image_reference(t, defined).isNotNull())
    alt = lambda t: F.regexp_extract(t, rf"(?s)^!\[({LABEL})\]", 1)
    return F.transform(known, lambda t: tx.let(_image_reference(t, defined), lambda d: _item(
        "IMAGE", _assemble(alt(t)), d["target"], d["title"], shown=False)))


def _literal_group(group: Column, defined: Column) -> Column:
    """A group that names no definition is text; images inside it are still images."""
    tokens = F.regexp_extract_all(_inner_of(group), F.lit(TOKENS), F.lit(0))
    head = F.regexp_extract(group, r"^(!?\[)", 1)
    middle = F.transform(tokens, lambda t: F.when(
        t.startswith("!") & t.endswith(")") & t.contains("]("), _item("IMAGE", _label(label_of(t)), target_of(t), title_of(t))).otherwise(_item("TEXT", _piece(t))))
    return F.concat(F.array(_item("TEXT", head)), middle, F.array(_item("TEXT", F.lit("]"))))


def rich_items(text: Column, defined: Column) -> Column:
    """``array<ITEM>``: text, links and images of inline Markdown, left to right.

    ``defined`` holds the definitions that the text may name. One scan carries how many brackets are
    open (no bare link begins inside one), the character before a token, and whether the token was
    used up as the label of the group before it.
    """
    defined = F.coalesce(defined, F.create_map().cast(DEFINED))
    group = lambda t: t.rlike(r"^!?\[") & t.endswith("]") & (F.length(t) > 1)
    look = lambda key: F.try_element_at(defined, key)

    def seen(t, after):
        """A token with the definition it names, and whether the group after it is its label."""
        beside = group(after) & after.startswith("[")
        label = label_key(_inner_of(after))
        named = F.when(group(t), F.when(beside & (label != ""), look(label)).otherwise(look(label_key(_inner_of(t)))))
        return F.struct(t.alias("t"), group(t).alias("group"), named.alias("by"), beside.alias("beside"))

    tokens = F.regexp_extract_all(text, F.lit(RICH_TOKENS), F.lit(0))
    read = tx.let(tokens, lambda ts: F.transform(ts, lambda t, i: tx.let(
        F.coalesce(F.try_element_at(ts, (i + 2).cast("int")), F.lit("")), lambda after: seen(t, after))))
    start = F.struct(F.lit(0).alias("open"), F.lit("").alias("last"), F.lit(False).alias("used"))

    def step(state, x):
        t = x["t"]
        taken = ~state["used"] & x["group"] & x["by"].isNotNull() & x["beside"]
        opened = F.when(t == "[", state["open"] + 1).when(t == "]", F.greatest(state["open"] - 1, F.lit(0))).otherwise(state["open"])
        return F.struct(opened.alias("open"), F.substring(t, -1, 1).alias("last"), taken.alias("used"))

    def out(state, x):
        t, by = x["t"], x["by"]
        one_image = lambda label, target, title: F.array(_item("IMAGE", label, target, title))
        link = lambda label, target, title: F.concat(F.array(_item("LINK", _rich_label(label, defined), target, title)), _images_in(label, defined))
        label = F.when(x["group"], _inner_of(t)).otherwise(label_of(t))
        target = F.when(x["group"], by["target"]).otherwise(target_of(t))
        title = F.when(x["group"], by["title"]).otherwise(title_of(t))
        address = F.regexp_replace(t, r"^(?i:mailto:|tel:)", "")
        as_url = F.array(_item("LINK", _shield(address), F.when(t.rlike(r"^(?i:www\.)"), F.concat(F.lit("http://"), t)).otherwise(t), F.lit("")))
        is_url = (state["open"] == 0) & state["last"].rlike(r"^[\s*_~(]?$") & t.rlike(rf"^{_HEAD}") & t.rlike(VALID_URL)
        inline = t.rlike(r"^!?\[") & t.endswith(")") & t.contains("](")
        return (F.when(state["used"], F.array().cast(f"array<{ITEM}>"))
                .when(x["group"] & by.isNull(), _literal_group(t, defined))
                .when((x["group"] | inline) & t.startswith("!"), one_image(_rich_label(label, defined), target, title))
                .when(x["group"] | inline, link(label, target, title))
                .when(is_url, as_url).otherwise(F.array(_item("TEXT", _piece(t)))))

    return F.flatten(tx.scan(read, start, step, out, f"array<{ITEM}>"))


def may_hold_link(text: Column) -> Column:
    """Whether a bare link may be in a text; a search for fixed strings, as nearly all texts have none."""
    low = F.lower(text)
    found = low.contains(URL_HINTS[0])
    for hint in URL_HINTS[1:]:
        found = found | low.contains(hint)
    return found


def may_define(text: Column) -> Column:
    return text.contains("]:") & text.rlike(MAY_DEFINE)


def rich_text(items: Column) -> Column:
    return _finish(F.array_join(F.transform(F.filter(items, lambda x: x["shown"]), lambda x: x["text"]), ""))


def rich_references(items: Column) -> Column:
    """Links and images of ``items`` with their visible texts."""
    return F.transform(F.filter(items, lambda x: x["kind"] != "TEXT"), lambda x: F.struct(
        x["kind"].alias("kind"), _finish(x["text"]).alias("text"), x["target"].alias("target"), x["title"].alias("title")))
