"""Submission checks and scores (inventory C2, C9, C10, N29): one violations frame, one row of scores."""

from __future__ import annotations

import ast
import json
import keyword
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.numbers import answer_match, f2

SAFE_PATH = r"^data/[A-Za-z0-9_./-]+\.csv$"


# Statements that a query must not hold, and the keys of an entry.
BANNED = (ast.Import, ast.ImportFrom, ast.With, ast.AsyncWith, ast.Try, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
KEYS = ["id", "question", "answer", "relevant_docs", "relevant_tables", "evidence", "pandas_query"]


def _fault(query: str | None) -> str | None:
    if query is None or not query.strip():
        return "empty query"
    try:
        tree = ast.parse(query)
    except (SyntaxError, ValueError):
        return "query isn't Python"
    return "forbidden statement" if any(isinstance(n, BANNED) for n in ast.walk(tree)) else None


def query_fault(query: Column) -> Column:
    """What is wrong with a query by its syntax tree; words inside strings don't count."""
    return F.pandas_udf(lambda s: s.map(_fault), T.StringType())(query)


def _is_name(name: str | None) -> bool:
    return bool(name) and name.isidentifier() and not keyword.iskeyword(name)


def violations(entries: DataFrame, files: DataFrame, expected: int) -> DataFrame:
    """Id, rule of all faults: entries as submitted, files (csv_path) as packed; ids must be 1 to ``expected``."""
    paths = entries.select("id", F.explode("evidence").alias("e")).select("id", F.col("e.variable").alias("variable"), F.col("e.csv_path").alias("csv_path"))
    named = F.pandas_udf(lambda s: s.map(_is_name), T.BooleanType())
    checked = entries.select("id", query_fault(F.col("pandas_query")).alias("rule")).where("rule is not null")
    lists = [c for c in ("relevant_docs", "relevant_tables", "evidence") if c in entries.columns]
    checks = [
        entries.where("id is null").select("id", F.lit("missing id").alias("rule")),
        entries.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("rule")),
        entries.where(~F.col("id").between(1, expected)).select("id", F.lit("id out of order").alias("rule")),
        entries.where("answer is null or isnan(answer) or abs(answer) = double('infinity')").select("id", F.lit("answer isn't a number").alias("rule")),
        entries.where(F.greatest(*(F.col(c).isNull() for c in lists))).select("id", F.lit("missing list").alias("rule")),
        checked,
        paths.where(~named("variable")).select("id", F.lit("not an identifier").alias("rule")),
        paths.where(~F.coalesce(F.col("csv_path").rlike(SAFE_PATH) & ~F.col("csv_path").contains(".."), F.lit(False))).select("id", F.lit("unsafe path").alias("rule")),
        paths.join(files, "csv_path", "left_anti").select("id", F.lit("file not packed").alias("rule")),
        entries.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit(None).cast("int").alias("id"), F.lit("wrong number of entries").alias("rule")),
    ]
    return reduce(DataFrame.unionByName, checks)


def read_zip(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Entries, files and what is wrong with the archive itself; one archive, read on the driver."""
    schema = "id int, question string, answer double, relevant_docs array<string>, relevant_tables array<string>, evidence array<struct<variable string, csv_path string>>, pandas_query string"
    faults, rows, names = [], [], []
    try:
        with zipfile.ZipFile(path) as z:
            names = z.namelist()
            found = json.loads(z.read("submission.json")) if "submission.json" in names else None
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        found, faults = [], [f"unreadable archive: {e}"]
    if found is None:
        faults.append("no submission.json")
    elif not isinstance(found, list):
        faults.append("submission.json isn't a list")
        found = []
    for r in found or []:
        missing = [k for k in KEYS if k not in r]
        faults += [f"entry {r.get('id')} lacks {k}" for k in missing]
        number = isinstance(r.get("answer"), (int, float)) and not isinstance(r.get("answer"), bool)
        rows.append((r.get("id") if isinstance(r.get("id"), int) else None, r.get("question"), float(r["answer"]) if number else None, *(r.get(k) for k in KEYS[3:])))
    return spark.createDataFrame(rows, schema), spark.createDataFrame([(n,) for n in names], "csv_path string"), faults


def scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Macro F2 of tables, answer and execution accuracy over all gold rows (id, answer, relevant_tables)."""
    p = predicted.select("id", F.col("answer").alias("got"), F.col("relevant_tables").alias("found"))
    both = gold.join(p, "id", "left")
    hit = F.size(F.array_intersect(F.coalesce("found", F.array().cast("array<string>")), "relevant_tables"))
    precision = F.coalesce(F.try_divide(hit, F.size(F.array_distinct("found"))), F.lit(0.0))
    recall = F.coalesce(F.try_divide(hit, F.size(F.array_distinct("relevant_tables"))), F.lit(0.0))
    return both.agg(
        F.avg(f2(precision, recall)).alias("f2"),
        F.avg(answer_match(F.col("got"), F.col("answer")).cast("double")).alias("answer_accuracy"),
        F.avg((F.col("got").isNotNull() & ~F.isnan("got")).cast("double")).alias("exec_rate"),
    )


#: Ratios of an answer to the true one that tell a unit mistaken, and how near they must be.
UNIT_RATIOS, UNIT_NEAR = [1e3, 1e-3, 1e6, 1e-6, 1e9, 1e-9], 0.05


def classify_error(retrieved: Column, executed: Column, got: Column, gold: Column) -> Column:
    """The first kind of error that applies; with the small ratios any answer that is far too small counts as a unit mistaken."""
    ratio = F.abs(F.try_divide(got, gold))
    unit = F.lit(False)
    for r in UNIT_RATIOS:
        unit = unit | (F.abs(ratio - r) < UNIT_NEAR)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(retrieved), "retrieval_miss").when(no(executed), "execution_fail_unrepaired").when(answer_match(got, gold), "ok")
        .when(F.coalesce(unit, F.lit(False)), "unit_mismatch").otherwise("generation_wrong_logic")
    )
