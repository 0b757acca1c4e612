"""Column functions on spreadsheet cells: references and what a stored value shows."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_column_index(reference: Column) -> Column:
    """0-based column of a reference such as ``BC12``."""
    letters = F.upper(F.regexp_extract(F.coalesce(reference, F.lit("")), r"^([A-Za-z]*)", 1))
    value = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)
    return F.greatest(value - 1, F.lit(0))


def cell_row_index(reference: Column) -> Column:
    """0-based row of a reference, -1 when it has none."""
    digits = F.regexp_extract(F.coalesce(reference, F.lit("")), r"^[A-Za-z]*([0-9]*)", 1)
    n = digits.try_cast("int")
    return F.when(n > 0, n - 1).otherwise(-1)


def is_safe_general_integer(raw: Column, number_format_id: Column) -> Column:
    return F.coalesce(number_format_id, F.lit(0)).eqNullSafe(0) & raw.rlike(r"^[+\-]*[0-9]{1,11}$") & raw.rlike(r"^[+\-]?[0-9]")


def value_semantics(cells: Column) -> dict[str, Column]:
    """Text, certainty and label of a stored cell: formula, string, boolean, error, number.

    ``cells`` is a struct with ``raw, type, formula, shared, inline, number_format_id``.
    """
    c = lambda n: cells[n]
    raw, kind = c("raw"), c("type")
    integer = is_safe_general_integer(raw, c("number_format_id"))
    shared = (kind == "s") & c("shared").isNotNull()
    is_bool = raw.isin("0", "1")
    text = (F.when(c("formula"), raw).when(shared, c("shared")).when(kind == "inlineStr", F.coalesce(c("inline"), F.lit("")))
            .when((kind == "b") & is_bool, F.when(raw == "1", "TRUE").otherwise("FALSE")).otherwise(raw))
    certainty = (F.when(c("formula"), "INFERRED").when(shared | kind.isin("inlineStr", "str", "e"), "SOURCE_EXACT")
                 .when(kind == "b", F.when(is_bool, "DERIVED_EXACT").otherwise("INFERRED"))
                 .when(integer, "DERIVED_EXACT").otherwise("INFERRED"))
    label = (F.when(c("formula"), "cached-formula-display-unverified").when(shared | kind.isin("inlineStr", "str"), "displayed-string")
             .when(kind == "b", "displayed-boolean").when(kind == "e", "displayed-error").when(integer, "displayed-general-integer")
             .when(F.coalesce(c("number_format_id"), F.lit(0)) == 0, "displayed-general-numeric-unverified")
             .otherwise("displayed-formatted-numeric-unverified"))
    return {"text": text, "certainty": certainty, "semantics": label}
