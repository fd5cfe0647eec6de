"""Sources (inventory S1-S15): reports, JSON lines with fixed schemas, evidence, dimensions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import clean_term, repaired_text

FACTS = "`chỉ_tiêu` string, `năm` int, `giá_trị` double, `đơn_vị` string, report_id string, start_line int, table_type string, company string, is_consolidated boolean"
EVIDENCE = "row_id long, metric string, canonical string, company string, year int, raw_value double, source_unit string, value double, target_unit string, report_id string, start_line int, is_consolidated boolean"


def reports(spark: SparkSession, root: str) -> DataFrame:
    """Path and whole text of report files, without smoke files."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return text.select(path.alias("path"), F.col("value").alias("text")).where("path like '%financial_statements%' and path not like '%\\_smoke%'")


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True)


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all text files under a folder; contents aren't read."""
    return _files(spark, root).option("pathGlobFilter", "*.txt").load(root).select("path")


def file_extensions(spark: SparkSession, root: str) -> DataFrame:
    """S3: how many files of each extension."""
    files = _files(spark, root).load(root).select("path")
    found = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1)
    return files.groupBy(F.when(found == "", "<noext>").otherwise(found).alias("extension")).count()


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows (the feature) by hash order of a key and seed."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def json_lines(spark: SparkSession, path: str, schema: str = FACTS, n: int | None = None, order: str | None = None) -> DataFrame:
    """Rows of a fixed schema; blank lines are skipped; with ``n`` the first by ``order``, or in the order of files and lines."""
    rows = spark.read.schema(schema).json(path)
    if n is None:
        return rows
    place = [order] if order else [F.col("_metadata.file_path"), F.monotonically_increasing_id()]
    return rows.orderBy(*place).limit(n)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The elements of an array, or one object, in a file of one JSON document."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def evidence(spark: SparkSession, path: str, schema: str = EVIDENCE) -> DataFrame:
    """Evidence files with a header; what doesn't fit the schema is null."""
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def company_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias, ticker from a headerless file of tickers and names."""
    rows = spark.read.csv(path, schema="ticker string, name string").where(F.col("ticker").rlike("^[A-Z]{2,5}$"))
    return rows.select(F.explode(F.array(F.lower("ticker"), F.lower("name"))).alias("alias"), "ticker").where("alias is not null")


def yaml_mapping(path: str) -> dict:
    """A small dimension file, read on the driver."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """Canonical, category, formula, children, alias, seq: a row for each alias, and for the canonical name itself."""
    rows = []
    for canonical, entry in yaml_mapping(path).items():
        entry = entry or {}
        for alias in [canonical, *(entry.get("aliases") or [])]:
            rows.append((entry.get("canonical") or canonical, entry.get("category"), entry.get("formula"), list(entry.get("children") or []), str(alias), len(rows)))
    return spark.createDataFrame(rows, "canonical string, category string, formula string, children array<string>, alias string, seq int")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Category, desc, example."""
    rows = [(k, (v or {}).get("desc"), (v or {}).get("example")) for k, v in yaml_mapping(path).items()]
    return spark.createDataFrame(rows, "category string, desc string, example string")


def index(spark: SparkSession, path: str) -> DataFrame:
    """An index as ``sinks.write_index`` left it, partitioned by company and year."""
    return spark.read.parquet(path)


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def canonical_map(terms: DataFrame) -> DataFrame:
    """Norm, canonical by the normalized raw and clean label of terms (raw, clean, canonical, seq); of equal keys the last."""
    clean = F.coalesce("clean", clean_term(F.col("raw")))
    keys = terms.where("canonical is not null").select("canonical", F.posexplode(F.array("raw", clean)).alias("k", "label"), "seq")
    named = keys.select(repaired_text(F.col("label")).alias("norm"), "canonical", F.struct("seq", "k").alias("at")).where("norm <> ''")
    return named.groupBy("norm").agg(F.max_by("canonical", "at").alias("canonical"))


def with_canonical(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (metric_raw) with the canonical name of their normalized label, null without one; the map is broadcast only if its size allows."""
    return rows.withColumn("norm", repaired_text(F.col("metric_raw"))).join(names, "norm", "left").drop("norm")


def first_of(spark: SparkSession, paths: list[str], schema: str = FACTS) -> DataFrame:
    """JSON lines of the first path that exists; an empty table if none does."""
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            return json_lines(spark, path, schema)
    return spark.createDataFrame([], schema)
