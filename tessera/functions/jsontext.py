"""JSON text: validity and indentation by two, number literals kept as written."""
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Number(str):
    """A number literal as it was read."""


class _Object(list):
    """Members of an object in order, repeated names included."""


def _reject(name):
    raise ValueError(name)


def _lines(value, pad: str) -> str:
    inner = pad + "  "
    if isinstance(value, _Object):
        members = [f"{inner}{json.dumps(k, ensure_ascii=False)}: {_lines(v, inner)}" for k, v in value]
        return "{\n" + ",\n".join(members) + f"\n{pad}}}" if members else "{}"
    if isinstance(value, list):
        return "[\n" + ",\n".join(inner + _lines(v, inner) for v in value) + f"\n{pad}]" if value else "[]"
    return value if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(StringType())
def _indent(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return _lines(json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_reject,
                                     object_pairs_hook=_Object), "")
        except (ValueError, RecursionError):
            return None
    return texts.map(one, na_action="ignore")


def json_to_text(text: Column) -> Column:
    """Indented JSON, null when the text is not valid JSON."""
    return _indent(text)


def json_error(text: Column, indented: Column) -> Column:
    return F.when(text.isNotNull() & indented.isNull(), "invalid_json")
