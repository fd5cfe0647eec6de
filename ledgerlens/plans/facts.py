"""Facts (company, year, metric, value) and the closed set of plan operations over them.

All plan operations are one aggregation over facts: operands are picked by
conditional aggregates, never by a loop over questions. Ties are broken by the
row order column or the key, stated in each docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import safe_ratio

METRICS = ["quantity", "extendedprice", "discount_amt", "tax_amt"]
FACTS_SQL = """facts AS (
  SELECT s_name AS company, CAST(year(l_shipdate) AS INTEGER) AS year, metric, CAST(sum(v) AS DOUBLE) AS value FROM (
    SELECT l_suppkey, l_shipdate, unnest(['quantity','extendedprice','discount_amt','tax_amt']) AS metric,
           unnest([CAST(q AS DECIMAL(18,4)), CAST(p AS DECIMAL(18,4)), CAST(p * d AS DECIMAL(18,4)), CAST(p * t AS DECIMAL(18,4))]) AS v
    FROM (SELECT l_suppkey, l_shipdate, CAST(l_quantity AS DECIMAL(12,2)) AS q, CAST(l_extendedprice AS DECIMAL(12,2)) AS p,
                 CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS t FROM lineitem)) x JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem summed to (supplier, year) before the join, then unpivoted to one row per metric."""
    price, exact = F.col("l_extendedprice").cast("decimal(12,2)"), "decimal(18,4)"
    items = load(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.year("l_shipdate").alias("year"),
        F.col("l_quantity").cast("decimal(12,2)").cast(exact).alias("quantity"),
        price.cast(exact).alias("extendedprice"),
        (price * F.col("l_discount").cast("decimal(4,2)")).cast(exact).alias("discount_amt"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast(exact).alias("tax_amt"),
    )
    sums = items.groupBy("l_suppkey", "year").agg(*(F.sum(m).alias(m) for m in METRICS))
    named = sums.join(load(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    totals = named.groupBy(F.col("s_name").alias("company"), "year").agg(*(F.sum(m).cast("double").alias(m) for m in METRICS))
    return totals.unpivot(["company", "year"], METRICS, "metric", "value")


def picked(metric: str, value: str = "value") -> Column:
    """The value of a metric in a group."""
    return F.max(F.when(F.col("metric") == metric, F.col(value)))


def binary(facts: DataFrame, op: str, a: str, b: str) -> DataFrame:
    """Sum, difference or ratio of two metrics of each (company, year)."""
    both = facts.where(F.col("metric").isin(a, b)).groupBy("company", "year").agg(picked(a).alias("a"), picked(b).alias("b"))
    x, y = F.col("a"), F.col("b")
    return both.select("company", "year", {"sum": x + y, "difference": x - y, "ratio": safe_ratio(x, y)}[op].alias("answer"))


def over_years(facts: DataFrame, op: str) -> DataFrame:
    """Last year against first year of each (company, metric); fewer than two years give no row."""
    ends = facts.groupBy("company", "metric").agg(
        F.min_by("value", "year").alias("lo"), F.max_by("value", "year").alias("hi"), F.countDistinct("year").alias("n")
    ).where("n >= 2")
    delta = F.col("hi") - F.col("lo")
    answer = delta if op == "year_delta" else safe_ratio(delta, F.abs("lo"))
    return ends.select("company", "metric", answer.alias("answer"))


def mean_nonnegative(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The mean without negatives, unless all are negative."""
    v = F.col(value)
    return rows.groupBy(key).agg(F.coalesce(F.avg(F.when(v >= 0, v)), F.avg(v)).alias("answer"))


def extreme(facts: DataFrame, op: str, by: str, selector: str, output: str, over: str | None = None) -> DataFrame:
    """At the key where the selector is extreme (ties: least key), the output metric, or its ratio to ``over``.

    One pass: operands are pivoted per key, then one ``min_by``-style aggregate picks the key.
    """
    keys = facts.groupBy(by, "company").agg(
        picked(selector).alias("s"), picked(output).alias("o"), *([picked(over).alias("d")] if over else [])
    )
    sign = -1 if op.startswith("argmax") else 1
    answer = safe_ratio(F.col("o"), F.col("d")) if over else F.col("o")
    best = F.min(F.struct((sign * F.col("s")).alias("k"), "company", answer.alias("answer")))
    return keys.where("s is not null").groupBy(by).agg(best.alias("b")).select(by, "b.company", "b.answer")


def first_nonnegative(facts: DataFrame, order: str) -> DataFrame:
    """Q11, lookup: the first row by ``order`` that isn't negative, else the first."""
    return facts.groupBy("company", "metric").agg(F.min_by("value", F.struct(F.col("value") < 0, F.col(order))).alias("answer"))


def argmax_abs(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the largest absolute value of each group, ties to the least metric."""
    best = F.min(F.struct((-F.abs("value")).alias("k"), "metric", "value"))
    return facts.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.metric", "b.value")


def lagged(facts: DataFrame, years: int) -> DataFrame:
    """Each value with that of exactly ``years`` earlier, through one window instead of a self join."""
    w = Window.partitionBy("company", "metric").orderBy("year").rangeBetween(-years, -years)
    return facts.withColumn("before", F.max("value").over(w)).where("before is not null")
