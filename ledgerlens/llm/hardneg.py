"""Hard-negative mining by dual-tree search.

An anchor's positives are the rows of its label with the largest inner products;
its hard negatives are rows of other labels whose inner product lies in a window
below a positive's. Both are searches of the same kind: each anchor has *asks*, a
range of scores from which it wants the k largest.

Candidates form a tree: cells (k-means on a bounded sample, the FIT_ROWS distinct
vectors with the least hash), parts of a cell (as many as its share asks for, so a
hot cell is no single task), leaves of LEAF rows by halving along the direction
between far points. Every node has a ball (centre, radius) and the labels inside as
a mask. Anchors form a tree of cells, blocks and leaves likewise. For two balls the
inner product lies in <a,c> -+ (|a| r_c + |c| r_a + r_a r_c); a pair of nodes whose
interval misses the ranges of all the group's asks is dropped for all its anchors at
once. Blocks of anchors go only to the cells that are left, once to each bin of chunks
that holds one; in a task leaves are taken by falling upper bound, pairs of leaves are scored
exactly, and the k-th best so far raises the lower end of an ask. A first round
visits the NEAR cells of each anchor cell, the second the others, with what the
first one found. So the result is exact; only the work depends on how well vectors
cluster: where they don't, all anchors meet all rows, in blocks.

Of equal vectors with equal label only the least k + 1 vec_ids are candidates: the
others can't be among the k best. Intermediate tables are in the shared folder.

Scores are integers; ties go to the smaller vec_id. Edge cases: rows without
vec_id, label or vector, with a null component, of another length than the most
common one, or with a squared length of 2^56 and more take no part. Fewer rows than
asked for: all. Rows that repeat a vec_id are rows each; an anchor's own row isn't
its positive, an equal second one is; anchor rows equal in all three columns are one
anchor. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bins, discard, in_blocks, materialize, table

FIT_ROWS = 16384
#: Rows of a cell, at most so many cells; rows of a part and of a leaf.
CELL_ROWS, MOST_CELLS = 4096, 1024
CHUNK, LEAF = 4096, 128
#: Anchors of a block and of a leaf.
BLOCK, ANCHOR_LEAF = 1024, 16
#: Cells that the first round visits, leaves that are scored together.
NEAR, AT_ONCE = 2, 8
LARGEST = 2**56
MOST = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min


def halves(v: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in groups of at most ``most``, by halving along the direction between two far points."""
    stack, out = [np.arange(len(v))], []
    while stack:
        at = stack.pop()
        if len(at) <= most:
            out.append(at)
            continue
        own = v[at]
        one = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        two = own[((own - one) ** 2).sum(axis=1).argmax()]
        by = at[np.argsort(own @ (two - one), kind="stable")]
        stack += [by[len(by) // 2 :], by[: len(by) // 2]]
    return out


def masks(labels: np.ndarray) -> int:
    """The labels of a node as bits; several labels may share one."""
    return int(np.bitwise_or.reduce(np.int64(1) << (labels % 64)))


def balls(v: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, radii and masks of groups of rows that follow each other."""
    cuts = np.append(0, np.cumsum(sizes))
    centres = np.stack([v[a:b].mean(axis=0) for a, b in zip(cuts, cuts[1:])])
    radii = np.array([np.sqrt(((v[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(cuts, cuts[1:], centres)])
    return centres, radii, np.array([masks(labels[a:b]) for a, b in zip(cuts, cuts[1:])])


def intervals(a: np.ndarray, r_a: np.ndarray, c: np.ndarray, r_c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner products of two sets of balls, wide enough for rounding."""
    mid = a @ c.T
    size_a, size_c = np.linalg.norm(a, axis=1), np.linalg.norm(c, axis=1)
    wide = np.outer(size_a, r_c) + np.outer(r_a, size_c) + np.outer(r_a, r_c)
    wide += 1 + 1e-9 * np.outer(size_a + r_a, size_c + r_c)
    return mid - wide, mid + wide


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where these hold them exactly."""
    most = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1).max() * (c.astype(np.float64) ** 2).sum(axis=1).max())
    if most < 2**52:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ c.astype(np.int64).T


def packed(v: np.ndarray) -> tuple[bytes, str]:
    """Integers in the narrowest type that holds them, and its name."""
    most = int(np.abs(v).max(initial=0))
    kind = "int16" if most < 2**15 else "int32" if most < 2**31 else "int64"
    return v.astype(kind).tobytes(), kind


def best(rows: np.ndarray, k: int) -> np.ndarray:
    """Of rows (anchor, ask, score, vec_id, place) the k best of each anchor and ask."""
    rows = rows[np.lexsort((rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))) if len(rows) else np.zeros(0, int)
    nth = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows[nth < k]


def leaf_search(v: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, node: dict, same: bool, k: int) -> np.ndarray:
    """The k best of a chunk for each ask (rows low, high: anchors x asks) of one leaf of anchors, as rows of ``best``."""
    found = np.zeros((0, 5), np.int64)
    low = low.copy()
    centre, radius, mask = balls(v.astype(np.float64), labels, np.array([len(v)]))
    least, most = (x[0] for x in intervals(centre, radius, node["centres"], node["radii"]))
    able = (node["masks"] & mask) != 0 if same else np.ones(len(most), bool)
    able &= least <= high.max()
    leaves = np.argsort(-most, kind="stable")
    leaves = leaves[able[leaves]]
    for i in range(0, len(leaves), AT_ONCE):
        some = leaves[i : i + AT_ONCE]
        some = some[most[some] >= low.min()]
        if not len(some):
            break
        at = np.concatenate([np.arange(node["cuts"][s], node["cuts"][s + 1]) for s in some])
        score = products(v, node["vecs"][at])
        fits = (labels[:, None] == node["labels"][at]) == same
        for ask in range(low.shape[1]):
            own = np.where(fits & (score >= low[:, ask, None]) & (score <= high[:, ask, None]), score, NONE)
            edge = np.partition(own, len(at) - k, axis=1)[:, len(at) - k, None] if len(at) > k else NONE
            row, column = np.nonzero((own >= edge) & (own > NONE))
            if len(row):
                place = at[column]
                found = np.concatenate([found, np.stack([row, np.full(len(row), ask), own[row, column], node["ids"][place], place], axis=1)])
        found = best(found, k)
        if len(found):
            n = np.zeros(low.shape, np.int64)
            np.add.at(n, (found[:, 0], found[:, 1]), 1)
            worst = np.full(low.shape, MOST)
            np.minimum.at(worst, (found[:, 0], found[:, 1]), found[:, 2])
            low = np.where(n == k, np.maximum(low, worst), low)
    return found


class Cells:
    """Centres of cells and their shares of the rows."""

    def __init__(self, x: np.ndarray, n_rows: int, seed: int = 12):
        rng = np.random.default_rng(seed)
        n = int(np.clip(min(n_rows // CELL_ROWS, len(x) // 8), 1, MOST_CELLS))
        self.centres = x[rng.choice(len(x), n, replace=False)]
        for _ in range(8):
            own = self.of(x)
            count = np.bincount(own, minlength=n)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, x)
            self.centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.centres)
        self.share = (np.bincount(self.of(x), minlength=n) + 1) / (len(x) + n)
        self.near = np.argsort(-(self.centres @ self.centres.T), axis=1, kind="stable")[:, :NEAR]

    def of(self, v: np.ndarray) -> np.ndarray:
        size = (self.centres**2).sum(axis=1)
        return in_blocks(lambda rows: (size - 2 * rows @ self.centres.T).argmin(axis=1), v)

    def parts(self, n_rows: int, size: int) -> np.ndarray:
        return np.maximum(1, np.ceil(self.share * n_rows / size)).astype(np.int64)


def _grouped(batches: Iterator[pd.DataFrame], by: list[str], most: int) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows of equal ``by`` together, at most ``most``; rows come sorted by it."""
    at, held, size = None, [], 0
    for pdf in batches:
        for key, part in pdf.groupby(by, sort=True):
            for i in range(0, len(part), most):
                piece = part.iloc[i : i + most]
                if held and (key != at or size + len(piece) > most):
                    yield at, pd.concat(held)
                    held, size = [], 0
                at = key
                held.append(piece)
                size += len(piece)
    if held:
        yield at, pd.concat(held)


class Search:
    """The tree of the candidates, and searches in it for asks of anchors."""

    def __init__(self, spark: SparkSession, rows: DataFrame, kept: int):
        """rows: vec_id, label, vec; of equal rows but for vec_id the ``kept`` least are candidates."""
        self.spark = spark
        copies = Window.partitionBy("label", "vec").orderBy("vec_id")
        rows = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= kept).drop("copy")
        rows = materialize(spark, rows, "candidates")
        n_rows = rows.count()
        share = F.pmod(F.xxhash64("vec"), F.lit(1 << 20))
        few = rows.where(share < (1 << 20) * min(1.0, 2 * FIT_ROWS / max(1, n_rows))).select("vec").distinct()
        sample = few.orderBy(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)), F.xxhash64("vec"), "vec").limit(FIT_ROWS).toPandas()["vec"]
        if not len(sample):  # a few copies of few vectors, none of the least hashes
            sample = rows.limit(FIT_ROWS).select("vec").toPandas()["vec"]
        self.empty = not len(sample)
        if self.empty:
            return
        cells = Cells(np.unique(np.stack(sample.to_numpy()).astype(np.float64), axis=0), n_rows)
        parts = cells.parts(n_rows, CHUNK)
        model = spark.sparkContext.broadcast((cells, parts, bins := Bins(parts)))

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells, parts, _ = model.value
            for pdf in batches:
                cell = cells.of(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
                mixed = pdf["vec_id"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                yield pdf.assign(cell=cell, part=(mixed % parts[cell].astype(np.uint64)).astype(np.int64))

        def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bins = model.value[2]
            for (cell, part), own in _grouped(batches, ["cell", "part"], 2 * CHUNK):
                v = np.stack(own["vec"].to_numpy()).astype(np.int64)
                groups = halves(v.astype(np.float64), LEAF)
                at, sizes = np.concatenate(groups), np.array([len(g) for g in groups])
                v, labels = v[at], own["label"].to_numpy(np.int64)[at]
                centres, radii, mask = balls(v.astype(np.float64), labels, sizes)
                vecs, kind = packed(v)
                whole = balls(v.astype(np.float64), labels, np.array([len(v)]))
                yield pd.DataFrame({
                    "bin": [int(bins.of(cell, part))], "cell": [cell], "ids": [own["vec_id"].to_numpy(np.int64)[at].tobytes()], "labels": [labels.tobytes()], "vecs": [vecs], "kind": [kind],
                    "sizes": [sizes.astype(np.int64).tobytes()], "centres": [centres.tobytes()], "radii": [radii.tobytes()], "masks": [mask.astype(np.int64).tobytes()],
                    "centre": [whole[0][0]], "radius": [whole[1][0]], "mask": [whole[2][0]],
                })

        in_cells = rows.mapInPandas(placed, "vec_id long, label long, vec array<long>, cell int, part int")
        chunks = in_cells.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInPandas(
            index, "bin int, cell int, ids binary, labels binary, vecs binary, kind string, sizes binary, centres binary, radii binary, masks binary, centre array<double>, radius double, mask long")
        self.chunks = materialize(spark, chunks, "tree")
        discard(spark, rows)
        # a cell's ball about its k-means centre: from the balls of its chunks
        known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cells.centres)], "cell int, middle array<double>")
        far = F.sqrt(F.aggregate(F.zip_with("centre", "middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)) + F.col("radius")
        own = self.chunks.select("cell", "centre", "radius", "mask").join(F.broadcast(known), "cell").groupBy("cell").agg(F.max(far).alias("radius"), F.bit_or("mask").alias("mask"))
        stats = own.toPandas()  # at most MOST_CELLS rows
        radii, mask = np.full(len(cells.centres), -1.0), np.zeros(len(cells.centres), np.int64)
        radii[stats["cell"]], mask[stats["cell"]] = stats["radius"] * (1 + 1e-9), stats["mask"]
        self.model = spark.sparkContext.broadcast((cells, bins, radii, mask))

    def anchors(self, rows: DataFrame, n_rows: int) -> DataFrame:
        """vec_id, key, label, vec, a_cell, a_part of the rows, in the shared folder."""
        model = self.model

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells = model.value[0]
            parts = cells.parts(n_rows, BLOCK).astype(np.uint64)
            for pdf in batches:
                cell = cells.of(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
                mixed = pdf["vec_id"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                yield pdf.assign(a_cell=cell, a_part=(mixed % parts[cell]).astype(np.int64))

        own = rows.select("vec_id", F.xxhash64("label", "vec").alias("key"), "label", "vec").dropDuplicates(["vec_id", "key"])
        return materialize(self.spark, own.mapInPandas(placed, "vec_id long, key long, label long, vec array<long>, a_cell int, a_part int"), "anchors")

    def _visit(self, asked: DataFrame, same: bool, k: int, near: bool) -> DataFrame:
        """a_id, key, ask, score, vec_id, own: what each chunk of the near (or the other) cells has for each ask."""
        model = self.model

        def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells, bins, radii, mask = model.value
            owned = bins.cells()
            for (cell, _), own in _grouped(batches, ["a_cell", "a_part"], BLOCK):
                v = np.stack(own["vec"].to_numpy()).astype(np.int64)
                groups = halves(v.astype(np.float64), ANCHOR_LEAF)
                own, sizes = own.iloc[np.concatenate(groups)], np.array([len(g) for g in groups])
                v, labels = v[np.concatenate(groups)], own["label"].to_numpy(np.int64)
                width = max(map(len, own["asks"]))
                filled = lambda column, rest: np.array([[*x, *[rest] * (width - len(x))] for x in own[column]], np.int64)  # noqa: E731, B023
                asks, low, high = filled("asks", 0), filled("low", MOST), filled("high", NONE)
                centres, wide, own_mask = balls(v.astype(np.float64), labels, sizes)
                cuts = np.append(0, np.cumsum(sizes))
                lowest, highest = np.minimum.reduceat(low.min(axis=1), cuts[:-1]), np.maximum.reduceat(high.max(axis=1), cuts[:-1])
                least, most = intervals(centres, wide, cells.centres, np.maximum(radii, 0))
                able = (radii >= 0) & (least <= highest[:, None]) & (most >= lowest[:, None])
                if same:
                    able &= (mask & own_mask[:, None]) != 0
                able &= np.isin(np.arange(len(radii)), cells.near[cell]) == near
                for target, there in enumerate(owned):
                    wanted = there[able[:, there].any(axis=0)]
                    if not len(wanted):
                        continue
                    some = able[:, wanted].any(axis=1)
                    at = np.repeat(some, sizes)
                    vecs, kind = packed(v[at])
                    yield pd.DataFrame({
                        "bin": [target], "cells": [wanted], "a_ids": [own["vec_id"].to_numpy(np.int64)[at].tobytes()], "a_keys": [own["key"].to_numpy(np.int64)[at].tobytes()],
                        "a_labels": [labels[at].tobytes()], "a_vecs": [vecs], "a_kind": [kind], "a_sizes": [sizes[some].astype(np.int64).tobytes()],
                        "asks": [asks[at].tobytes()], "low": [low[at].tobytes()], "high": [high[at].tobytes()],
                    })

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    ids, labels, sizes = (np.frombuffer(x, np.int64) for x in (r.ids, r.labels, r.sizes))
                    node = {"ids": ids, "labels": labels, "vecs": np.frombuffer(r.vecs, r.kind).reshape(len(ids), -1), "cuts": np.append(0, np.cumsum(sizes)),
                            "centres": np.frombuffer(r.centres).reshape(len(sizes), -1), "radii": np.frombuffer(r.radii), "masks": np.frombuffer(r.masks, np.int64)}
                    a_ids, keys, a_labels, a_sizes = (np.frombuffer(x, np.int64) for x in (r.a_ids, r.a_keys, r.a_labels, r.a_sizes))
                    v = np.frombuffer(r.a_vecs, r.a_kind).reshape(len(a_ids), -1)
                    asks, low, high = (np.frombuffer(x, np.int64).reshape(len(a_ids), -1) for x in (r.asks, r.low, r.high))
                    cuts, out = np.append(0, np.cumsum(a_sizes)), []
                    for a, b in zip(cuts, cuts[1:]):
                        found = leaf_search(v[a:b], a_labels[a:b], low[a:b], high[a:b], node, same, k)
                        found[:, 0] += a
                        out.append(found)
                    row, ask, score, vec_id, place = np.concatenate(out).T
                    own = (vec_id == a_ids[row]) & (labels[place] == a_labels[row]) & (node["vecs"][place] == v[row]).all(axis=1)
                    yield pd.DataFrame({"a_id": a_ids[row], "key": keys[row], "ask": asks[row, ask], "score": score, "vec_id": vec_id, "own": own})

        asking = asked.repartition("a_cell", "a_part").sortWithinPartitions("a_cell", "a_part").mapInPandas(
            blocks, "bin int, cells array<int>, a_ids binary, a_keys binary, a_labels binary, a_vecs binary, a_kind string, a_sizes binary, asks binary, low binary, high binary")
        chunks = self.chunks.drop("centre", "radius", "mask")
        # a bin's chunks are held while its blocks of anchors pass
        pairs = asking.join(chunks, "bin").where(F.array_contains("cells", F.col("cell"))).drop("bin", "cells", "cell")
        found = pairs.mapInPandas(search, "a_id long, key long, ask long, score long, vec_id long, own boolean")
        return top(found, k)

    def largest(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """a_id, key, ask, score, vec_id, own: the k best rows of the anchor's label (or of others) for each ask.

        asked: a row of ``anchors`` with asks, low and high, arrays of equal length.
        """
        first = materialize(self.spark, self._visit(asked, same, k, near=True), "first")
        floors = first.groupBy("a_id", "key", "ask").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        floors = floors.groupBy("a_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("ask", "least"))).alias("floors")).withColumnRenamed("a_id", "vec_id")
        raised = F.zip_with("asks", "low", lambda ask, low: F.greatest(low, F.coalesce(F.try_element_at("floors", ask), low)))
        rest = self._visit(asked.join(floors, ["vec_id", "key"], "left").withColumn("low", raised).drop("floors"), same, k, near=False)
        return materialize(self.spark, top(first.union(rest), k), "best")


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each ask."""
    order = Window.partitionBy("a_id", "key", "ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def hard_negatives(spark: SparkSession, rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, vec (array of integers). A negative's score is at least ``low`` and at most ``high`` hundredths
    of the positive's.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<long>").alias("vec"))
    size = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.where("vec_id is not null and label is not null and vec is not null").where(~F.exists("vec", lambda x: x.isNull())).where(size < LARGEST)
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vec") == (common[0].n if common else 0))
    tree = Search(spark, rows, max(positives, negatives) + 1)
    if tree.empty:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = tree.anchors(rows.where(is_anchor), rows.where(is_anchor).count())
    one = lambda x: F.array(F.lit(x).cast("long"))
    found = tree.largest(anchors.withColumns({"asks": one(0), "low": one(NONE + 1), "high": one(MOST)}), True, positives + 1)
    # the anchor's own row goes, once
    mine = Window.partitionBy("a_id", "key", "own").orderBy("vec_id")
    order = Window.partitionBy("a_id", "key").orderBy(F.desc("score"), "vec_id")
    others = found.withColumn("copy", F.row_number().over(mine)).where(~(F.col("own") & (F.col("copy") == 1)))
    ranked = others.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    ranked = ranked.select(F.col("a_id").alias("anchor_id"), "key", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # no score lies in the window of a negative one
    asks = ranked.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(F.array_sort(F.collect_set("positive_score")).alias("asks"))
    asked = anchors.join(asks, ["vec_id", "key"]).withColumns({"low": F.expr(f"transform(asks, s -> (s * {low} + 99) div 100)"), "high": F.expr(f"transform(asks, s -> s * {high} div 100)")})
    below = tree.largest(asked, False, negatives).select(F.col("a_id").alias("anchor_id"), "key", F.col("ask").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    each = Window.partitionBy("anchor_id", "key", "nth").orderBy(F.desc("negative_score"), "negative_id")
    out = ranked.join(below, ["anchor_id", "key", "positive_score"]).withColumn("rank", F.row_number().over(each))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings``: components in 256ths, anchors every vec_id divisible by 50, labels shifted where it is divisible by 7."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where(~F.exists("vec", odd)).withColumn("vec", F.transform("vec", lambda x: F.floor(256 * x)))
    return hard_negatives(spark, rows, F.col("vec_id") % 50 == 0)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 3
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE_SQL = {"op12_hard_negatives": SQL}
