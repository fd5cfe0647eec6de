"""Number parsers and rounding (inventory N6-N8, N15-N18): two parsers with rules of their own, never merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import let


def parse_vn_number(s: Column) -> Column:
    """Dot for thousands, comma for decimals, (x) negative; a leading minus or % gives null."""
    t = F.regexp_replace(F.trim(s), r"\s+", "")
    negative = t.rlike(r"^\(.*\)$")
    bare = F.when(negative, F.regexp_replace(t, r"^\(|\)$", "")).otherwise(t)
    grouped = F.regexp_replace(bare, r"\.", "")
    number = (
        F.when(~bare.rlike(r"^[0-9.,]+$") | ~bare.rlike("[0-9]"), None)
        .when(bare.contains(".") & bare.contains(","), F.regexp_replace(grouped, ",", "."))
        .when(bare.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$") | bare.rlike(r"\..*\."), grouped)
        .when(bare.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$"), F.regexp_replace(bare, ",", ""))
        .when(bare.contains(","), F.regexp_replace(bare, ",", "."))
        .otherwise(bare)
    )
    value = number.try_cast("double")
    return F.when(negative, -value).otherwise(value)


def parse_plain_number(s: Column) -> Column:
    """Commas removed, dashes are 0, (x) negative, nan and inf read as floats."""
    t = F.lower(F.trim(F.regexp_replace(s, ",", "")))
    negative = t.rlike(r"^\(.*\)$")
    bare = F.when(negative, F.regexp_replace(t, r"^\(|\)$", "")).otherwise(t)
    value = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), bare.try_cast("double")).when(
        bare.rlike(r"^[+-]?(nan|inf|infinity)$"), F.regexp_replace(F.regexp_replace(bare, "^(.?)inf$", "$1infinity"), "nan", "NaN").try_cast("double")
    )
    return F.when(t.isin("-", "—", "–"), 0.0).when(negative, -value).otherwise(value)


def cell_value(s: Column) -> Column:
    """U8: a table cell; dashes and blanks are null here."""
    return let(F.trim(s), lambda t: F.when(t.isin("", "-", "--", "–"), None).otherwise(parse_vn_number(t)))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def safe_ratio(a: Column, b: Column, times: float = 100.0) -> Column:
    """A / b, 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a, b) * times, F.lit(0.0))


def recall_at_k(found: Column, gold: Column, k: int) -> Column:
    """N15."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(F.slice(found, 1, k), gold)), F.size(F.array_distinct(gold))), F.lit(0.0))


def f2(p: Column, r: Column) -> Column:
    """N16."""
    return F.coalesce(F.try_divide(5 * p * r, 4 * p + r), F.lit(0.0))


def answer_match(a: Column, b: Column, abs_tol: float = 1.0, rel_tol: float = 1e-3) -> Column:
    """Near in absolute or relative terms."""
    return F.coalesce((F.abs(a - b) <= abs_tol) | (F.abs(a - b) <= rel_tol * F.abs(b)), F.lit(False))
