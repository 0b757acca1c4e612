"""Column functions on HTML source: tag tokens, entities, attributes."""
import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# One alternative per token type. Repeats inside a tag are possessive: Java would otherwise recurse
# once per attribute.
TAG_STREAM = (
    r"(?is)<!--.*?-->"
    r"|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<template\b[^>]*>.*?</template\s*>"
    r"|</?[a-z][^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>|<![^>]*+>|[^<]++|<"
)
ENTITY = r"&#[xX][0-9a-fA-F]{1,6};|&#[0-9]{1,7};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"
# The named entities come from the language's own table of HTML 4 names.
NAMED = json.dumps({f"&{k};": chr(v) for k, v in html.entities.name2codepoint.items()} | {"&apos;": "'"})


def _code_point(hex_digits: Column) -> Column:
    """The character of a number; U+FFFD for zero, surrogates and numbers beyond Unicode."""
    number = F.conv(hex_digits, 16, 10).cast("bigint")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.when(valid, hex_digits).otherwise("FFFD"), 8, "0")), "UTF-32")


def _decode_piece(piece: Column) -> Column:
    named = F.element_at(F.from_json(F.lit(NAMED), "map<string,string>"), piece)
    return (F.when(~piece.startswith("&"), piece)
            .when(piece.rlike("^&#[xX]"), _code_point(F.regexp_extract(piece, "([0-9a-fA-F]+);", 1)))
            .when(piece.startswith("&#"),
                  _code_point(F.hex(F.regexp_extract(piece, "([0-9]+);", 1).cast("bigint"))))
            .otherwise(F.coalesce(named, piece)))


def decode_entities(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.when(text.contains("&"),
                  F.array_join(F.transform(pieces, _decode_piece), "")).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, '' when it has none, null when it is absent."""
    present = tag.rlike(rf"(?is)^<[a-z0-9]+(?:[^>]*[\s\"'])?{name}(?:[\s=/>])")
    value = F.regexp_extract(
        tag, rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 0)
    bare = F.regexp_replace(value, rf"(?is)^[\s\"']{name}\s*=\s*", "")
    unquoted = F.when(bare.rlike("^[\"']"), F.regexp_replace(bare, "^[\"']|[\"']$", "")).otherwise(bare)
    return F.when(present, decode_entities(unquoted))


def strip_tags(page: Column) -> Column:
    """Plain text of a page the way a direct extractor returns it (script text included)."""
    text = F.regexp_replace(page, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<[a-zA-Z/!][^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>", "")
    return decode_entities(text)
