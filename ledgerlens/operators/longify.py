"""Tables to long facts (inventory U1-U8), all in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import cell_value
from ledgerlens.functions.text import let

FIRST_YEAR, LAST_YEAR = 2010, 2026
# Header cells and units.
HEADER_YEAR = r"(?iu)(?:31/12|01/01|N[aă]m|S[ốo] cu[ốo]i n[aă]m|S[ốo] [đd][ầu] n[aă]m)\s*((?:19|20)\d{2})"
DATE_YEAR = r"\d{1,2}[/\-.]\d{1,2}[/\-.]((?:19|20)\d{2})"
OPEN_DATE = r"01[/\-.]01[/\-.](?:19|20)\d{2}"
NAMED_YEAR = r"(?iu)(?:N[aă]m|Year)\s*((?:19|20)\d{2})"
THIS_YEAR = r"(?iu)n[aă]m nay|s[ốo] cu[ốo]i n[aă]m"
LAST_YEARS = r"(?iu)n[aă]m trư[ớu]c|s[ốo] [đd][ầu] n[aă]m"
BARE_YEAR = r"(?<![0-9])((?:19|20)\d{2})(?![0-9])"
CELL_UNIT = r"(?iu)(VND|VNĐ|Triệu VND|tỷ đồng|triệu đồng|nghìn đồng|đồng)"
HEAD_WORDS = r"(?iu)m[ãa] s[ốo]|ch[ỉi] ti[êe]u|t[àa]i s[ảa]n|thuy[ếe]t minh"
MAIN_HEADER_ROWS, NOTES_HEADER_ROWS = 4, 6


def _bounded(year: Column) -> Column:
    y = year.try_cast("int")
    return F.when(y.between(FIRST_YEAR, LAST_YEAR), y)


def header_year(cell: Column, record_year: Column, notes: bool = False) -> Column:
    """The year of a header cell; the first rule that matches decides, even by giving none.

    ``notes`` also takes a bare year, as in ``2018VND``.
    """
    opens = cell.rlike(r"^\s*01/01")
    found = (
        F.when(cell.rlike(HEADER_YEAR), _bounded(F.regexp_extract(cell, HEADER_YEAR, 1)) - F.when(opens, 1).otherwise(0))
        .when(cell.rlike(DATE_YEAR), _bounded(F.regexp_extract(cell, DATE_YEAR, 1)) - F.when(F.regexp_extract(cell, DATE_YEAR, 0).rlike(r"^01/01"), 1).otherwise(0))
        .when(cell.rlike(NAMED_YEAR), _bounded(F.regexp_extract(cell, NAMED_YEAR, 1)))
    )
    if notes:
        found = found.when(cell.rlike(BARE_YEAR), _bounded(F.regexp_extract(cell, BARE_YEAR, 1)))
    return found.when(cell.rlike(THIS_YEAR), record_year).when(cell.rlike(LAST_YEARS), record_year - 1)


def _in_range(year: Column) -> Column:
    return F.when(year.between(FIRST_YEAR, LAST_YEAR), year)


def _first(grid: Column, i: Column) -> Column:
    """The first value of column i in rows of arrays."""
    return F.get(F.filter(F.transform(grid, lambda row: F.get(row, i)), lambda y: y.isNotNull()), 0)


def _main_columns(rows: DataFrame) -> DataFrame:
    """The year of each column by the header rows, and the row at which the body starts."""
    years = F.transform(F.slice("rows", 1, MAIN_HEADER_ROWS), lambda r: F.transform(r, lambda c, i: F.when(i > 0, header_year(c, F.col("year")))))
    rows = rows.withColumn("head", years)
    columns = let(F.col("head"), lambda head: F.transform(_places("head"), lambda i: F.struct(i.alias("i"), _first(head, i).alias("year"))))
    with_year = F.array_position(F.transform("head", lambda h: F.exists(h, lambda y: y.isNotNull())), True).cast("int")
    start = F.when(with_year > 0, with_year).when(F.array_join(F.get("rows", 0), " ").rlike(HEAD_WORDS), 1).otherwise(0)
    return rows.withColumns({"columns": F.filter(columns, lambda s: s.year.isNotNull()), "start": start}).drop("head")


def _places(grid: str) -> Column:
    """0 up to the widest row; one more where dates may have shifted."""
    return F.sequence(F.lit(0), F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0)))


def _notes_columns(rows: DataFrame) -> DataFrame:
    """As for main statements, then bare years; years that begin in cell 0 stand for the columns from 1 on, whatever else says."""
    top = F.slice("rows", 1, NOTES_HEADER_ROWS)
    named = F.transform(F.slice("rows", 1, MAIN_HEADER_ROWS), lambda r: F.transform(r, lambda c, i: F.when(i > 0, header_year(c, F.col("year")))))
    bare = F.transform(top, lambda r: F.transform(r, lambda c: _in_range(F.regexp_extract(c, BARE_YEAR, 1).try_cast("int"))))
    own = lambda r: F.filter(r, lambda y: y.isNotNull())

    def shifted(grid: Column) -> Column:
        dated = F.filter(grid, lambda r: F.get(r, 0).isNotNull())
        return F.reverse(F.transform(dated, lambda r: F.concat(F.array(F.lit(None).cast("int")), own(r))))

    def columns_of(g: Column) -> Column:
        year = lambda i: F.coalesce(_first(g["shifted"], i), F.when(i > 0, F.coalesce(_first(g["named"], i), _first(g["bare"], i))))
        return F.filter(F.transform(_places("rows"), lambda i: F.struct(i.alias("i"), year(i).alias("year"))), lambda s: s.year.isNotNull())

    # each grid is made once, not once for each column
    columns = let(bare, lambda grid: let(F.struct(shifted(grid).alias("shifted"), named.alias("named"), grid.alias("bare")), columns_of))
    rows = rows.withColumn("columns", columns)
    least = F.array_min(F.transform("columns", lambda s: s.i))
    start = F.array_position(F.transform(top, lambda r: F.size(r) > least), True).cast("int")
    return rows.withColumn("start", F.coalesce(start, F.lit(0)))


def longify(tables: DataFrame, notes: bool = False) -> DataFrame:
    """A row for each labelled row and year column with a number; extra columns of ``tables`` are left out.

    ``notes`` takes tables of all types, six header rows, bare years and rows of two cells, and prefers the record's unit.
    """
    key = ["report_id", "start_line", "table_type", "company", "is_consolidated"]
    rows = tables if notes else tables.where(F.col("table_type").isin("CDKT", "KQKD", "LCTT"))
    units = F.transform(F.flatten(F.slice("rows", 1, NOTES_HEADER_ROWS if notes else 3)), lambda c: F.regexp_extract(c, CELL_UNIT, 1))
    own = F.get(F.filter(units, lambda u: u != ""), 0)
    rows = rows.select(*key, "year", "rows", (F.coalesce(F.nullif("unit", F.lit("")), own) if notes else F.coalesce(own, "unit")).alias("unit"))
    rows = (_notes_columns if notes else _main_columns)(rows)
    rows = rows.select(*key, "unit", "columns", F.slice("rows", F.col("start") + 1, F.greatest(F.size("rows") - F.col("start"), F.lit(0))).alias("body"))
    cells = rows.select(*key, "unit", "columns", F.posexplode("body").alias("row_seq", "r")).where(F.size("r") >= (1 if notes else 3))
    label = F.trim(F.get("r", 0))
    long = cells.where(label != "").select(*key, "unit", "row_seq", label.alias("metric_raw"), "r", F.explode("columns").alias("c"))
    value = cell_value(F.get(F.col("r"), F.col("c.i")))
    return long.select(*key, "unit", "row_seq", "metric_raw", F.col("c.year").alias("year"), value.alias("value")).where("value is not null")


def long_stats(long: DataFrame) -> DataFrame:
    """Rows, tables with rows, distinct years and their bounds of long rows, in one pass."""
    return long.agg(F.count("*").alias("n_rows"), F.countDistinct("report_id", "start_line").alias("n_tables"), F.countDistinct("year").alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def raw_labels(tables: DataFrame) -> DataFrame:
    """Label and place of the first table row that has it, of all distinct labels."""
    cells = tables.select("report_id", "start_line", F.posexplode(F.transform("rows", lambda r: F.trim(F.get(r, 0)))).alias("row_seq", "raw")).where("raw <> ''")
    return cells.groupBy("raw").agg(F.min(F.struct("report_id", "start_line", "row_seq")).alias("first"))


def all_facts(main: DataFrame, notes: DataFrame) -> DataFrame:
    """Main statements and notes together; rows in both are told apart later."""
    return main.unionByName(notes, allowMissingColumns=True)
