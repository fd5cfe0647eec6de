"""From raw documents to token counts: toxicity, near duplicates, benchmark passages, BPE.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
``run`` writes each stage's result as Parquet in the shared folder and reads it
again. All but the last stage return the columns of ``documents``.

Edge cases: every stage takes null and empty texts, repeated rows and empty
tables as its operator defines; a document without text is not toxic, links to
the other documents without words (one of them stays), holds no benchmark
passage and has no tokens. Rows are judged by their own text, also where they
repeat a doc_id or have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import bpe, decontam, simhash, toxicity
from ledgerlens.llm.common import discard, materialize, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (at the threshold of their language) go."""
    return toxicity.reject_toxic(spark, docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked SimHash fingerprints the document with the least doc_id stays."""
    small_batches(spark)
    return simhash.keep_first(spark, docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    small_batches(spark)
    return bpe.encode_documents(docs, bpe.public_vocabulary())


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("bpe", encode)]

#: A trained net, a graph search and a tokenizer have no SQL; a test holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(spark, last)  # what the stage before wrote has been read
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
