"""Evaluation and control (inventory A7, A17, A21-A23, C6, C11, C13, N19, N20, N30, N31, R10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns that tell the operations of an emitted query.
OPERATION_PATTERNS = {
    "lookup_simple": r"\.iloc\[0\]|\.loc\[",
    "pct_change": r"pct_change|/\s*abs\(",
    "ratio": r"/\s*float|/.*\*\s*100",
    "groupby": r"\.groupby\(",
    "merge_multi_table": r"\.merge\(|pd\.concat",
    "filter_year": r"\['năm'\]|year",
    "aggregation": r"\.sum\(\)|\.mean\(\)|\.agg\(",
}
LEAST_SHARE = 0.05


def rate(part: Column, whole: Column) -> Column:
    """Part / whole, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def pattern_counts(queries: DataFrame, column: str, patterns: Mapping[str, str]) -> DataFrame:
    """(pattern, n): rows whose text matches, all patterns in one pass."""
    sums = queries.agg(*(F.count_if(F.col(column).rlike("(?iu)" + p)).alias(name) for name, p in patterns.items()))
    return sums.unpivot([], list(patterns), "pattern", "n")


def means_by(rows: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Means of each group and, under a null key and overall = true, of all rows; one pass."""
    means = [F.avg(m).alias(m) for m in measures]
    return rows.rollup(key).agg(F.grouping(key).cast("boolean").alias("overall"), F.count("*").alias("n"), *means)


def retrieval_quality(found: DataFrame, gold: DataFrame, cuts: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """query_id, intent, recall@k, hit of each gold query; found is (query_id, doc_id, rank), gold (query_id, intent, doc_id)."""
    wanted = gold.select("query_id", "intent", "doc_id").distinct()
    ranks = found.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    both = wanted.join(ranks, ["query_id", "doc_id"], "left")
    recalls = [rate(F.count_if(F.col("rank") <= k), F.count("*")).alias(f"recall_{k}") for k in cuts]
    return both.groupBy("query_id", "intent").agg(*recalls, F.max(F.col("rank").isNotNull()).alias("hit"))


def misses(found: DataFrame, gold: DataFrame, k: int = 20) -> DataFrame:
    """The gold queries none of whose documents is among the first k."""
    top = found.where(F.col("rank") <= k).select("query_id", "doc_id")
    met = gold.join(top, ["query_id", "doc_id"], "left_semi").select("query_id")
    return gold.select("query_id", "intent").distinct().join(met, "query_id", "left_anti")


def extraction_report(reports: DataFrame, tables: DataFrame) -> DataFrame:
    """One row: files, those with tables and with a main statement, their shares, tables by kind, and tables per file (nearest rank).

    reports has report_id, tables report_id, table_type, unit, company.
    """
    main = F.col("table_type").isin("CDKT", "KQKD", "LCTT")
    per_file = tables.groupBy("report_id").agg(F.count("*").alias("n"), F.max(main).alias("main"))
    files = reports.select("report_id").distinct().join(per_file, "report_id", "left").agg(
        F.count("*").alias("total_files"), F.count("n").alias("files_with_tables"), F.count_if("main").alias("files_with_main"))
    ranks = per_file.withColumn("i", F.row_number().over(Window.orderBy("n", "report_id")) - 1).crossJoin(F.broadcast(per_file.agg(F.count("*").alias("m"))))
    at = lambda p: F.max(F.when(F.col("i") == F.bround(p * (F.col("m") - 1)).cast("int"), F.col("n")))
    spread = ranks.agg(F.min("n").alias("least"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("n").alias("most"), F.avg("n").alias("mean"))
    kinds = ("CDKT", "KQKD", "LCTT", "THUYET_MINH", "UNKNOWN")
    counts = tables.agg(
        F.count("*").alias("n_tables"), F.count_if(main).alias("n_main"), F.count_if(F.coalesce("unit", F.lit("")) != "").alias("n_with_unit"), F.countDistinct("company").alias("companies"),
        *(F.count_if(F.col("table_type") == k).alias(f"n_{k.lower()}") for k in kinds))
    out = files.crossJoin(counts).crossJoin(spread)  # one row each
    return out.withColumns({"coverage": rate(F.col("files_with_tables"), F.col("total_files")), "main_coverage": rate(F.col("files_with_main"), F.col("total_files"))})


def best_config(scored: DataFrame) -> DataFrame:
    """The configuration with the largest 0.5 f2 + 0.5 answer_accuracy, ties to the first name."""
    total = scored.withColumn("score", 0.5 * F.col("f2") + 0.5 * F.col("answer_accuracy"))
    return total.agg(F.min(F.struct((-F.col("score")).alias("k"), "config")).alias("b")).select("b.config", (-F.col("b.k")).alias("score")).where("config is not null")


def shares(rows: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """Each category's count and share of all rows, and whether it is under LEAST_SHARE; a category without rows has 0."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    out = taxonomy.select(key).distinct().join(counts, key, "left").join(F.broadcast(total))
    share = rate(F.coalesce("n", F.lit(0)), F.col("total"))
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), (share < LEAST_SHARE).alias("rare"))


def gates(facts: DataFrame, thresholds: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """C11: (gate, value, least, passed) of aggregates against their least values; one pass, null fails."""
    row = facts.agg(*(v.cast("double").alias(name) for name, (v, _) in thresholds.items()))
    long = row.unpivot([], list(thresholds), "gate", "value")
    least = reduce(lambda c, i: c.when(F.col("gate") == i[0], F.lit(float(i[1][1]))), list(thresholds.items())[1:], _first(thresholds))
    return long.withColumn("least", least).withColumn("passed", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))


def _first(thresholds: Mapping[str, tuple[Column, float]]) -> Column:
    name, (_, least) = next(iter(thresholds.items()))
    return F.when(F.col("gate") == name, F.lit(float(least)))


def sane(value: Column) -> Column:
    """A number that isn't NaN."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value), F.lit(False))


def last_lines(error: Column, n: int = 3) -> Column:
    """The last lines of an error."""
    lines = F.split(error, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")


def year_available(years: Column, wanted: Column) -> Column:
    """Whether the wanted year is among those there are."""
    return F.coalesce(F.array_contains(years, wanted), F.lit(False))


#: What an answer of these intents lies between.
RANGES = {"financial_index": (-200.0, 200.0), "calc_ratio": (-500.0, 500.0)}


def verify(answer: Column, intent: Column) -> Column:
    """Struct (valid, issues): an answer is a number and lies in the range of its intent, if that has one."""
    outside = F.lit(False)
    for name, (low, high) in RANGES.items():
        outside = outside | (intent.eqNullSafe(F.lit(name)) & ~answer.between(low, high))
    empty = F.when(~sane(answer), F.lit("answer is empty or NaN"))
    far = F.when(F.coalesce(outside, F.lit(False)), F.lit("answer is out of range"))
    issues = F.array_compact(F.array(empty, far))
    return F.struct((F.size(issues) == 0).alias("valid"), issues.alias("issues"))


def notes_format(gold: DataFrame) -> DataFrame:
    """n_notes_qa and the share of them with a number for an answer (null if there are none)."""
    notes = F.col("category").isin("notes_qa", "thuyet_minh")
    numeric = F.count_if(notes & F.col("answer").try_cast("double").isNotNull())
    return gold.agg(F.count_if(notes).alias("n_notes_qa"), F.try_divide(numeric, F.count_if(notes)).alias("numeric_answer_ratio"))
