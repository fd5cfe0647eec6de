"""Tables as texts for a reader or a model (inventory N24, O8, F13): Columns over rows (array of arrays of strings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a table that are shown; the limit is the feature (a preview).
PREVIEW = 15


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def structured(rows: Column, company: Column, year: Column, kind: Column, unit: Column, canonical: Column | None = None) -> Column:
    """Head and labels with bars between; ``canonical`` maps lower-case labels to names, shown where they differ."""
    labels = F.filter(F.transform(F.slice(rows, 1, PREVIEW), lambda r: F.get(r, 0)), lambda x: F.coalesce(x, F.lit("")) != "")
    if canonical is not None:
        known = lambda x: F.element_at(canonical, F.lower(x))
        labels = F.transform(labels, lambda x: F.when(known(x).isNotNull() & (known(x) != x), F.concat(x, F.lit(" ("), known(x), F.lit(")"))).otherwise(x))
    head = [F.concat(F.lit(f"{name}: "), _text(c)) for name, c in (("Công ty", company), ("Năm", year), ("Loại bảng", kind), ("Đơn vị", unit))]
    return F.concat_ws(" | ", F.array(*head), labels)


def markdown(rows: Column, columns: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    rule = line(F.transform(columns, lambda _: F.lit("---")))
    return F.concat_ws("\n", F.array(line(columns), rule), F.transform(F.slice(rows, 1, PREVIEW), line))


def compact_json(rows: Column, columns: Column, unit: Column, company: Column, year: Column) -> Column:
    whole = F.struct(columns.alias("columns"), F.slice(rows, 1, PREVIEW).alias("rows"), unit.alias("unit"), company.alias("company"), year.alias("year"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


def relevant(rows: Column, columns: Column, terms: Column) -> Column:
    """markdown of the rows whose label holds one of the terms; of all if none does."""
    lower = F.transform(terms, F.lower)
    hit = F.filter(rows, lambda r: F.exists(lower, lambda t: F.lower(F.coalesce(F.get(r, 0), F.lit(""))).contains(t)))
    return markdown(F.when(F.size(hit) > 0, hit).otherwise(rows), columns)
