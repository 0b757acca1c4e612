"""Visible text, links and images of inline Markdown, by the patterns of ``functions.markdown``, one text at a time.

Patterns read as Java reads them: classes are those of ASCII, except letters and numbers, and ``.`` and the end
of a text know Java's line terminators.
"""
import functools
import re

from . import markdown as md

TERMINATORS = "\n\r\x85\u2028\u2029"
SPACES = r" \t\n\x0b\f\r"


def java(pattern: str, flags: int = re.ASCII) -> re.Pattern:
    """A pattern for text without carriage returns, as Java reads it."""
    known = lambda rest, new: lambda p: re.sub(rf"(\\.|\[(?:\\.|[^\]\\])*\])|({rest})", lambda m: m[1] or new, p)
    if not re.match(r"\(\?i?s", pattern):
        pattern = known(r"\.", f"[^{TERMINATORS}]")(pattern)
    return re.compile(known(r"\$", r"(?=[\n\x85\u2028\u2029]?\Z)")(pattern), flags)


def _unicode(pattern: str) -> re.Pattern:
    """A pattern with classes of letters and numbers of all scripts; its white space stays that of ASCII."""
    for old, new in ((r"[^\p{L}\p{N}*]", r"(?:[^\w*]|_)"), (r"[^\p{L}\p{N}_]", r"\W"), (r"[\p{L}\p{N}_\-]", r"[\w\-]"),
                     (r"[\p{L}\p{N}\-]", r"(?:[^\W_]|-)"), (r"[\p{L}\p{N}]", r"[^\W_]"), (r"[^\s*]", f"[^{SPACES}*]"),
                     (r"[^\s_]", f"[^{SPACES}_]"), (r"[^\s~]", f"[^{SPACES}~]"), (r"[^@\s]", f"[^@{SPACES}]")):
        pattern = pattern.replace(old, new)
    assert "\\p" not in pattern and "\\s" not in pattern
    return java(pattern, 0)


_TOKENS, _RICH, _SPECIAL = java(md.TOKENS), java(md.RICH_TOKENS), java(md.SPECIAL)
_OPEN, _END, _TARGET = java(r"^!?\["), java(rf"(?s)\]{md.TARGET}$"), java(rf"(?s)\]({md.TARGET})$")
_URL_OF, _TITLE_OF, _PADDED = java(r"(?s)^\((\S*?)(?:\s+\"[^\"]*\")?\)$"), java(r"(?s)\s+\"([^\"]*)\"\)$"), java(r"(?s)^ .*[^ ].* $")
_CODE, _HTML, _ESCAPE = java("(?s)^`.+`$"), java(rf"(?s)^(?:{md.HTML}|{md.ENTITY})$"), java(rf"^{md.ESCAPE}$")
_IMAGE, _NESTED = java(rf"!\[({md.LABEL})\]{md.TARGET}"), java(rf"(?s){md.ESCAPE}|{md.CODE}|{md.IMAGE}|.")
_EMPHASIS = [(_unicode(p), mark) for p, mark in zip(md._EMPHASIS, "***__~")]
_ESCAPED, _BLANKS, _INNER = java(r"\\([!-/:-@\[-`{-~])"), java(r"\s+"), java(r"(?s)^!?\[(.*)\]$")
_IMAGES = java(rf"(?s){md.ESCAPE}|{md.CODE}|{md.IMAGE}|!\[{md.LABEL}\](?:\[{md.LABEL}\])?+|.")
_ALT, _SECOND, _HEAD = java(rf"(?s)^!\[({md.LABEL})\]"), java(rf"(?s)^!\[{md.LABEL}\]\[({md.LABEL})\]$"), java(rf"^{md._HEAD}")
_BEFORE, _SCHEME, _WWW = java(r"^[\s*_~(]?$"), java(r"^(?i:mailto:|tel:)"), java(r"^(?i:www\.)")
_either = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
_VALID = _unicode(rf"(?s)^(?:(?:{_either('http')}[sS]?|{_either('ftp')})://{md._HOST}|{_either('www')}\.{md._HOST}|{_either('mailto')}:[^@\s]+@{md._HOST}|{_either('tel')}:.*[0-9])")
_LABELS = java(rf"(?s)\[({md.LABEL})\]")
_SHIELD = {ord(a): b for a, b in zip(md.PUNCTUATION, md.SHIELDS)}
_BARE = {ord(b): a for a, b in zip(md.PUNCTUATION, md.SHIELDS)}


def _group(found: re.Match | None) -> str:
    return found[1] or "" if found else ""


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def key_of(label: str) -> str:
    """Labels are equal without case and with white space collapsed; their escapes stay."""
    return _BLANKS.sub(" ", label).strip(" ").lower()


def keys_of(text: str) -> list[str]:
    """Distinct keys of all bracket groups that can name a definition."""
    return [k for k in dict.fromkeys(map(key_of, _LABELS.findall(text))) if k]


def _label_of(token: str) -> str:
    return _END.sub("", _OPEN.sub("", token))


def _target_of(token: str) -> str:
    return unescape(_group(_URL_OF.search(_group(_TARGET.search(token)))))


def _title_of(token: str) -> str:
    return _group(_TITLE_OF.search(token))


def _piece(token: str, label=None) -> str:
    first = token[0]
    if first == "\\" and _ESCAPE.search(token):
        return token[1].translate(_SHIELD)
    if first == "`" and _CODE.search(token):
        body = token.strip("`")
        return (body[1:-1] if _PADDED.search(body) else body).translate(_SHIELD)
    if first in "<&" and _HTML.search(token):
        return ""
    if label is not None and "](" in token:
        return label(_label_of(token))
    return token


def _tokens(pattern: re.Pattern, text: str) -> list[str]:
    return [m[0] for m in pattern.finditer(text)]


def _assemble(text: str, label=None) -> str:
    return "".join([_piece(t, label) for t in _tokens(_TOKENS, text)])


def _finish(shielded: str) -> str:
    for pattern, mark in _EMPHASIS:
        if mark in shielded:
            shielded = pattern.sub(r"\1\2", shielded)
    return shielded.translate(_BARE)


def _label(text: str) -> str:
    """Label of a link: an image in it counts with its alternative text."""
    return _assemble(_IMAGE.sub(r"\1", text)) if _SPECIAL.search(text) else text


def _label_text(token: str) -> str:
    label = _label_of(token)
    return _finish(_label(label)) if _SPECIAL.search(label) else label


def _references(text: str) -> list[str]:
    """Link and image tokens in reading order; an image inside a link follows it."""
    found = []
    for t in _tokens(_TOKENS, text):
        if t.endswith(")") and "](" in t:
            found.append(t)
            if t[0] == "[":
                found += [i for i in _tokens(_NESTED, t[1:]) if len(i) > 4 and i.startswith("![")]
    return found


def _plain(text: str) -> tuple[str, tuple]:
    shown = _finish(_assemble(text, _label)) if _SPECIAL.search(text) else text
    refs = _references(text) if "](" in text else ()
    return shown, tuple(("IMAGE" if t[0] == "!" else "LINK", _label_text(t), _target_of(t), _title_of(t)) for t in refs)


def _is_group(token: str) -> bool:
    return len(token) > 1 and token[-1] == "]" and bool(_OPEN.search(token))


def _inner_of(group: str) -> str:
    return _INNER.sub(r"\1", group)


def _known_images(label: str, defined: dict) -> list[tuple[str, tuple]]:
    """Images of a label, inline or by a reference that is defined, with target and title."""
    out = []
    for t in _tokens(_IMAGES, label):
        if len(t) > 3 and t.startswith("!["):
            if t.endswith(")"):
                out.append((t, (_target_of(t), _title_of(t))))
            elif (by := defined.get(key_of(_group(_SECOND.search(t)) or _group(_ALT.search(t))))) is not None:
                out.append((t, by))
    return out


def _rich_label(label: str, defined: dict) -> str:
    """Text of a label: its images count with their alternative texts."""
    if not _SPECIAL.search(label):
        return label
    swapped = label
    for t, _ in _known_images(label, defined):
        swapped = swapped.replace(t, _group(_ALT.search(t)))
    return _assemble(swapped)


def _literal_group(group: str) -> list[tuple]:
    """A group that names no definition is text; images inside it are still images."""
    out = [("TEXT", group[:2] if group[0] == "!" else group[:1])]
    for t in _tokens(_TOKENS, _inner_of(group)):
        if t[0] == "!" and t.endswith(")") and "](" in t:
            out.append(("IMAGE", _label(_label_of(t)), _target_of(t), _title_of(t)))
        else:
            out.append(("TEXT", _piece(t)))
    return [*out, ("TEXT", "]")]


def _rich(text: str, defined: dict) -> tuple[str, tuple]:
    """References resolved, bare links found: no bare link begins inside brackets or after a letter."""
    tokens, items, opened, last, used = _tokens(_RICH, text), [], 0, "", False
    for i, t in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        group = _is_group(t)
        beside = after[:1] == "[" and _is_group(after)
        by = None
        if group:
            by = defined.get((beside and key_of(_inner_of(after))) or key_of(_inner_of(t)))
        inline = t.endswith(")") and "](" in t and bool(_OPEN.search(t))
        if used:
            pass
        elif group and by is None:
            items += [(*x, None, None)[:4] + (True,) for x in _literal_group(t)]
        elif group or inline:
            label = _inner_of(t) if group else _label_of(t)
            target, title = by if group else (_target_of(t), _title_of(t))
            items.append(("IMAGE" if t[0] == "!" else "LINK", _rich_label(label, defined), target, title, True))
            if t[0] != "!":
                items += [("IMAGE", _assemble(_group(_ALT.search(x))), *d, False) for x, d in _known_images(label, defined)]
        elif opened == 0 and _HEAD.search(t) and _BEFORE.search(last) and _VALID.search(t):
            items.append(("LINK", _SCHEME.sub("", t).translate(_SHIELD), f"http://{t}" if _WWW.search(t) else t, "", True))
        else:
            items.append(("TEXT", _piece(t), None, None, True))
        used = not used and group and by is not None and beside
        opened = opened + 1 if t == "[" else max(opened - 1, 0) if t == "]" else opened
        last = t[-1]
    shown = _finish("".join([x[1] for x in items if x[4]]))
    return shown, tuple((k, _finish(x), target, title) for k, x, target, title, _ in items if k != "TEXT")


# Outputs of one document repeat its texts; long ones are not held.
_HELD = 1 << 12
_held_plain, _held_rich = functools.lru_cache(_HELD)(_plain), functools.lru_cache(_HELD)(lambda text: _rich(text, {}))


def inlines(text: str, defined: dict | None = None) -> tuple[str, tuple]:
    """Visible text, and kind, text, target and title of links and images; ``defined`` holds the definitions that the text names.

    References and bare links take the longer scan; everything else the short one.
    """
    if defined:
        return _rich(text, defined)
    if ":" in text or "." in text:
        low = text.lower()
        if any(hint in low for hint in md.URL_HINTS):
            return _held_rich(text) if len(text) < _HELD else _rich(text, {})
    if not _SPECIAL.search(text) and "](" not in text:
        return text, ()
    return _held_plain(text) if len(text) < _HELD else _plain(text)
