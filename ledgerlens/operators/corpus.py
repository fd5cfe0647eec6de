"""Texts to retrieve (inventory R1, R2, R8, R9, R11, E7): one document of a table or of a metric, and expanded questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a table that its document names.
TABLE_ROWS = 40
#: Aliases of a term that a question gains.
MORE_ALIASES = 3


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _term() -> Column:
    """The canonical name, else the raw label; null if both are empty."""
    return F.coalesce(F.nullif(F.col("canonical"), F.lit("")), F.nullif(F.col("metric"), F.lit("")))


def table_documents(rows: DataFrame) -> DataFrame:
    """table_key, text of each (report_id, start_line, company, year) of long rows in order of seq.

    Only the first TABLE_ROWS rows of a table are gathered, so a group is bounded.
    """
    key = ["report_id", "start_line", "company", "year"]
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where(F.col("i") <= TABLE_ROWS)
    head = F.concat_ws(
        " | ", F.concat(F.lit("Công ty: "), _text("company")), F.concat(F.lit("Năm: "), _text("year")),
        F.concat(F.lit("Loại bảng: "), _text("table_type")), F.concat(F.lit("Đơn vị: "), _text("unit")), F.concat(F.lit("report: "), _text("report_id")),
    )
    words = F.array_compact(F.array(_term(), F.nullif(F.col("metric"), F.lit(""))))
    found = first.groupBy(*key).agg(F.min_by(head, "i").alias("head"), F.array_sort(F.collect_list(F.struct("i", words.alias("w")))).alias("rows"))
    named = F.array_distinct(F.flatten(F.transform("rows", lambda r: r["w"])))
    return found.select(
        F.concat_ws("|", _text("report_id"), _text("start_line")).alias("table_key"), "company", "year",
        F.concat_ws(" | ", F.array("head"), named).alias("text"),
    )


def metric_documents(rows: DataFrame) -> DataFrame:
    """One document of each (report_id, start_line, term, year), made of the first row by seq."""
    named = rows.withColumn("term", _term()).where("report_id is not null and term is not null")
    kept = ["company", "table_type", "metric"]
    one = named.groupBy("report_id", "start_line", "term", "year").agg(F.min_by(F.struct(*kept), "seq").alias("r")).select("*", "r.*")
    text = F.concat(
        F.lit("Công ty "), _text("company"), F.lit(" ticker "), _text("company"), F.lit(" năm "), _text("year"), F.lit(" "), _text("table_type"),
        F.lit(" "), F.col("term"), F.lit(" "), _text("metric"), F.lit(" report "), _text("report_id"),
    )
    return one.select(F.concat_ws("|", _text("report_id"), _text("start_line")).alias("table_key"), "company", "year", F.col("term").alias("canonical"), text.alias("text"))


def expand(question: Column, aliases: Column, years: Column | None = None) -> Column:
    """The question with the first aliases of each of its terms (an array of arrays) and, if given, its years."""
    more = F.flatten(F.transform(aliases, lambda a: F.slice(a, 1, MORE_ALIASES)))
    parts = [F.array(question), more] + ([] if years is None else [years.cast("array<string>")])
    return F.concat_ws(" ", *(F.coalesce(p, F.array().cast("array<string>")) for p in parts))
