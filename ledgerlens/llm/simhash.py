"""SimHash near-duplicate detection with pigeonring filtering.

Two 64-bit fingerprints link when they differ in at most ``TAU`` = 4 bits. The
64 bits stand in a ring of 5 segments. If the whole ring differs in at most 4
bits, some chain of consecutive segments starts with prefixes whose cumulative
differences stay within their proportional budgets: after l segments at most
floor(4 * l / 5) bits, that is 0, 1, 2, 3, 4. So every linked pair agrees on
some segment exactly and differs in at most one bit of the next; these two
budgets are the join key (26 bits: one index row and one probe row for each
one-bit variant). The budgets of the third and fourth segments prune what
meets under a key, and the full Hamming check decides.

Edge cases: a null or empty text, or one of separators only, has fingerprint 0
and links like any other. Fewer words than a shingle form one shingle. Repeated
rows and copies share a fingerprint, so they are one node of the graph however
many they are. A row with a null doc_id keeps its row and is never the least id
of a component unless all its ids are null. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize, table

WORDS_PER_SHINGLE = 4
SEED = 42
TAU = 4
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
#: Pairs compared at once, and hashes counted at once.
BLOCK = 1 << 18
#: Rows of sorted keys that are gathered before their runs are compared.
ROWS = 1 << 16


def fingerprint(text: str | None, k: int = WORDS_PER_SHINGLE) -> int:
    """The fingerprint of one text as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[min(k, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    on = np.flatnonzero(2 * counts > len(hashes))
    return int(sum(1 << int(b) for b in on))


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    out = np.fromiter((fingerprint(t) for t in texts), dtype=np.uint64, count=len(texts))
    return pd.Series(out.view(np.int64))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprints("text").alias("fp"))


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(STARTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def _chain_mask(i: int, length: int) -> np.uint64:
    m = 0
    for j in range(i, i + length):
        m |= ((1 << WIDTHS[j % 5]) - 1) << STARTS[j % 5]
    return np.uint64(m)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index and probe rows: key, fp, probe."""
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(5):
            j = (i + 1) % 5
            head = (np.uint64(i) << np.uint64(26)) | (_segment(fps, i) << np.uint64(13))
            tail = _segment(fps, j)
            keys = [head | tail] + [head | (tail ^ np.uint64(1 << b)) for b in range(WIDTHS[j])]
            n = len(fps)
            yield pa.record_batch(
                {
                    "key": pa.array(np.concatenate(keys).astype(np.int32)),
                    "fp": pa.array(np.tile(fps.view(np.int64), len(keys))),
                    "probe": pa.array(np.arange(n * len(keys)) >= n),
                }
            )


def _components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) that connect what the pairs (a, b) connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _verified(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that pass the third and fourth budgets of their chain, then the full check."""
    diff = a ^ b
    first = (key >> 26).astype(np.int64)
    for length in (3, 4):
        masks = np.array([_chain_mask(i, length) for i in range(5)], dtype=np.uint64)
        keep = np.bitwise_count(diff & masks[first]) <= TAU * length // 5
        a, b, diff, first = a[keep], b[keep], diff[keep], first[keep]
    keep = (np.bitwise_count(diff) <= TAU) & (diff != 0)
    return a[keep], b[keep]


def _run_edges(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star edges of whole runs of equal keys, at most BLOCK pairs at a time."""
    order = np.lexsort((probe, key))
    key, fp, probe = key[order], fp[order], probe[order]
    stop = np.searchsorted(key, key, side="right")
    rows = np.flatnonzero(~probe)
    counts = stop[rows] - rows - 1  # an index row meets the index rows after it and all probes of its run
    rows, counts = rows[counts > 0], counts[counts > 0]
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), BLOCK, side="right")) + at)
        r, c = rows[at:upto], counts[at:upto]
        left = np.repeat(r, c)
        right = np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c) + left + 1
        a, b = _verified(key[left], fp[left], fp[right])
        if len(a):
            yield _components(a, b)
        at = upto


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key; a run that goes on in the next batch waits for it."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n, enough = 0, ROWS

    def edges(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> Iterator[pa.RecordBatch]:
        for u, v in _run_edges(key, fp, probe):
            yield pa.record_batch({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        held.append((key, fp, batch.column("probe").to_numpy(zero_copy_only=False)))
        n += len(key)
        if n < enough:
            continue
        rows = [np.concatenate(x) for x in zip(*held)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from edges(*(x[:last] for x in rows))
        held = [tuple(x[last:].copy() for x in rows)]
        n = len(held[0][0])
        enough = max(ROWS, 2 * n)
    if n:
        yield from edges(*(np.concatenate(x) for x in zip(*held)))


def link_edges(distinct_fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints within TAU bits of each other."""
    keys = distinct_fps.mapInArrow(_emit_keys, "key int, fp long, probe boolean")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_link_runs, "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable), copies (documents of the fingerprint)."""
    marked = materialize(spark, with_fingerprints(docs), "fingerprints")
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    groups = materialize(spark, groups, "groups")
    parts = connected_components(spark, link_edges(groups.select("fp")))
    joined = groups.join(parts, groups.fp == parts.node, "left").select(
        "fp", "least", "copies", F.coalesce("component", "fp").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(least, "component").select("fp", "copies", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id", "copies")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of each component one row, with all columns: that with the least doc_id (null last), then the least hash of the text.

    Rows are told apart by doc_id and text, so rows that repeat a doc_id with other texts are documents of their own.
    """
    fp, mark = "__simhash", "__simhash_mark"
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text"))
    marked = materialize(spark, docs.withColumn(fp, _fingerprints("text")).withColumn(mark, own), "marked")
    rows = materialize(spark, marked.groupBy(fp, mark).agg(F.count("*").alias("n")), "groups")
    groups = rows.groupBy(F.col(fp).alias("fp")).agg(F.min(mark).alias("least"))
    parts = connected_components(spark, link_edges(groups.select("fp")))
    joined = groups.join(parts, groups.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    chosen = joined.groupBy("component").agg(F.min(F.struct("least", "fp")).alias("b")).select(F.col("b.fp").alias(fp), F.col("b.least").alias(mark))
    kept = marked.join(chosen, [fp, mark], "left_semi")
    if not rows.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([fp, mark])
    return kept.select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: doc_id, fingerprint (16 hex digits), component_id, copies."""
    pairs = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return pairs.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict[str, str] = {}
