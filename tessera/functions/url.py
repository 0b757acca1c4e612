"""Column functions on links: schemes, safe links and images, canonical form, asset paths."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, trim_ws

CONTROL = r"[\x{00}-\x{1F}\x{7F}]"
# --- fixed values: characters written as percent escapes inside a Markdown link target --------
MARKDOWN_URL_ESCAPES = ((" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E"))
# --- fixed values: default ports dropped from canonical links ---------------------------------
DEFAULT_PORTS = (("http", "80"), ("https", "443"), ("ftp", "21"))
# --- fixed values: ASCII characters a canonical link carries as percent escapes ---------------
CANONICAL_ESCAPES = ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("^", "%5E"),
                     ("`", "%60"), ("{", "%7B"), ("|", "%7C"), ("}", "%7D"))


def anchor_id(text: Column) -> Column:
    kept = F.regexp_replace(trim_ws(text), r"[^A-Za-z0-9_.\-:/#\t-\r\x{85}\p{Z}]", "")
    dashed = F.regexp_replace(kept, r"[\-:/#\t-\r\x{85}\p{Z}]+", "-")
    bare = F.regexp_replace(dashed, "^-|-$", "")
    return F.when(bare == "", F.lit("anchor")).otherwise(bare)


def url_scheme(url: Column) -> Column:
    scheme = F.regexp_extract(url, r"^([A-Za-z0-9+.\-]+):", 1)
    return F.when(scheme != "", scheme)


def _cleaned(url: Column) -> Column:
    return trim_ws(F.regexp_replace(url, CONTROL, ""))


def safe_link(url: Column) -> Column:
    """The link if it may be emitted, else null."""
    u = _cleaned(url)
    scheme = F.lower(url_scheme(u))
    return (F.when(u == "", None)
            .when(u.startswith("#"), F.concat(F.lit("#"), anchor_id(F.substring(u, 2, 1 << 30))))
            .when(scheme.isNull() | scheme.isin("http", "https", "mailto"), u))


def safe_image(url: Column) -> Column:
    """The image source if it may be emitted, else null."""
    u = _cleaned(url)
    scheme = F.lower(url_scheme(u))
    path = F.lower(F.regexp_extract(u, r"^([^?#]*)", 1))
    return (F.when((u == "") | u.startswith("#") | path.endswith(".svg"), None)
            .when(scheme.isNull() | scheme.isin("http", "https"), u))


def _markdown_escapes(url: Column) -> Column:
    for raw, escaped in MARKDOWN_URL_ESCAPES:
        url = F.replace(url, F.lit(raw), F.lit(escaped))
    return url


def markdown_link_url(url: Column) -> Column:
    return F.coalesce(_markdown_escapes(safe_link(url)), F.lit("#"))


def markdown_image_url(url: Column) -> Column:
    return F.coalesce(_markdown_escapes(safe_image(url)), F.lit(""))


def asset_url(path: Column) -> Column:
    """Percent-encode every byte but unreserved characters and the slash."""
    encoded = F.url_encode(path)
    for raw, escaped in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(raw), F.lit(escaped))
    return encoded


def _percent_encode(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(r"[\x{00}-\x{7F}]+|[^\x{00}-\x{7F}]+"), F.lit(0))
    text = F.array_join(F.transform(pieces, lambda p: F.when(
        p.rlike(r"[^\x{00}-\x{7F}]"), F.url_encode(p)).otherwise(p)), "")
    for raw, escaped in CANONICAL_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def without_dots(path: Column) -> Column:
    """An absolute path without dot segments; one that goes above the root stays there."""
    parts = F.split(path, "/")
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), lambda kept, x: (
        F.when(x == ".", kept).when(x == "..", up(kept)).otherwise(F.concat(kept, F.array(x)))))
    whole = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.array_join(whole, "/")).otherwise(path)


def canonical_uri(value: Column) -> Column:
    """Absolute links in canonical form, everything else trimmed; blank becomes ''.

    Hierarchical links get lower-case scheme and host, no default port, at least '/' as path and no
    dot segments.
    """
    v = trim_ws(F.coalesce(value, F.lit("")))
    web = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(.*)$"
    part = lambda i: F.regexp_extract(v, web, i)
    scheme, authority = F.lower(part(1)), part(2)
    host = F.lower(authority)
    for s, port in DEFAULT_PORTS:
        host = F.when(scheme == s, F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    path = F.when(part(3) == "", F.lit("/")).otherwise(without_dots(part(3)))
    absolute = F.concat(scheme, F.lit("://"), host, _percent_encode(F.concat(path, part(4))))
    opaque = F.concat(F.lower(url_scheme(v)), F.lit(":"),
                      F.regexp_extract(v, r"^[^:]*:(.*)$", 1))
    return (F.when(v.rlike(web), absolute)
            .when(v.rlike(r"^(?i:mailto|urn|data|tel|news|javascript):"), opaque)
            .otherwise(v))
