"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Vectors are scaled to length 1, so that cosine is an inner product. Product
quantisation with 16 centres in each of SUBSPACES gives four-bit codes. Codes
and codebooks minimise h_par |r_par|^2 + h_perp |r_perp|^2, where r is what is
left of a vector and r_par its part along the vector, since only that part
shifts large inner products; h_par / h_perp = ANISOTROPY. Codes are chosen a
subspace at a time given the others; all codebooks together solve one linear
least-squares problem.

The vectors lie in cells, each with the centre of the largest inner product
(spherical k-means). Centres and codebooks are fitted on a bounded sample: the
FIT_ROWS vectors with the least hash of (vec_id, vector), copies once. Every vector is then
put in its cell, encoded and indexed; a cell is dealt over as many parts as its
share of the sample asks for, so that a hot cell is no single task. A query probes
the fewest cells that held CELL_RECALL of the neighbours in the sample of PROBED
queries, measured when the index is fitted: few where vectors cluster, most where
they don't or where queries lie elsewhere than rows. A cell's number of parts counts copies. Queries (a stated set) go to their cells in blocks of QUERY_BLOCK, once
to each bin of chunks, and meet the chunks there by a join on the bin; the chunk is scanned through the
queries' look-up tables, and the RERANK best by the tables, ties to the smaller
vec_id, get exact cosines in double precision; the k-th of these is a bar, and so does
every other row that can reach it by what its codes leave (kept with them). So a
chunk's k nearest are exact, also among near copies, whose codes are equal; only cells
that aren't probed can hide neighbours. The best k of all chunks are the answer. In a chunk, of equal vectors only the k + 2 least vec_ids are scanned: the
others can't be nearest. Recall against brute force is measured in the tests.

Edge cases: vectors that are null, zero, of another length than the most common
one, or hold null or non-finite components take no part, neither do rows without
a vec_id. Equal vectors tie and go by vec_id. Fewer candidates than k: all. An
empty table: an empty result. Extra columns are ignored. Rows that repeat a
vec_id are candidates each; a query's own row alone isn't its candidate. Query rows
of equal vec_id and vector are one query, those of equal vec_id and other vectors
several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bins, in_blocks, table

CENTRES = 16
SUB_DIM = 2
ANISOTROPY = 4.0
FIT_ROWS = 16384
FIT_ROUNDS = 4
QUERY_BLOCK = 1024
#: Vectors of a chunk that are scored exactly in any case; they set the bar for the others.
RERANK = 320
CHUNK = 8192
#: Vectors of a cell; cells are at most MOST_CELLS.
CELL_ROWS, MOST_CELLS = 4096, 1024
CELL_RECALL = 0.985
#: Queries of the sample that measure it.
PROBED = 512


class Quantiser:
    """Codebooks (subspaces, 16, SUB_DIM) for vectors padded to a multiple of SUB_DIM."""

    def __init__(self, books: np.ndarray):
        self.books = books

    @staticmethod
    def parts(x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % SUB_DIM
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB_DIM)

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 5) -> Quantiser:
        """x: unit vectors."""
        rng = np.random.default_rng(seed)
        parts = cls.parts(x).astype(np.float64)
        n, m, _ = parts.shape
        books = parts[rng.choice(n, CENTRES, replace=n < CENTRES)].transpose(1, 0, 2) + rng.normal(0, 1e-3, (m, CENTRES, SUB_DIM))
        made = cls(books)
        for _ in range(3):  # plain k-means of each subspace to begin with
            codes = np.stack([((parts[:, s, None] - made.books[s]) ** 2).sum(-1).argmin(1) for s in range(m)], axis=1)
            for s in range(m):
                for c in range(CENTRES):
                    if (at := codes[:, s] == c).any():
                        made.books[s, c] = parts[at, s].mean(axis=0)
        for _ in range(FIT_ROUNDS):
            made._solve(parts, made.encode(x))
        return made

    def _solve(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """The codebooks that minimise the loss for given codes, by the normal equations."""
        n, m, d = parts.shape
        size = m * CENTRES * d
        a, b, count = np.zeros((size, size)), np.zeros(size), np.zeros(size)
        column = ((np.arange(m) * CENTRES + codes) * d)[:, :, None] + np.arange(d)
        for i in range(0, n, 2048):
            at, x = column[i : i + 2048].reshape(-1, m * d), parts[i : i + 2048].reshape(-1, m * d)
            v = np.zeros((len(x), size))
            np.put_along_axis(v, at, x, axis=1)
            a += (ANISOTROPY - 1) * (v.T @ v)
            b += ANISOTROPY * v.sum(axis=0)
            count += np.bincount(at.ravel(), minlength=size)
        a[np.diag_indices(size)] += count + 1e-6
        b += 1e-6 * self.books.ravel()
        self.books = np.linalg.solve(a, b).reshape(m, CENTRES, d)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows, subspaces), from nearest centres by coordinate descent on the loss."""
        return in_blocks(self._encode, x)

    def _encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        parts = self.parts(x).astype(np.float64)
        n, m, _ = parts.shape
        codes = np.empty((n, m), np.int64)
        errors, alongs = [], []
        for s in range(m):
            rest = parts[:, s, None] - self.books[s]
            errors.append((rest**2).sum(-1))
            alongs.append((rest * parts[:, s, None]).sum(-1))
            codes[:, s] = errors[s].argmin(1)
        rows = np.arange(n)
        along = sum(alongs[s][rows, codes[:, s]] for s in range(m))
        for _ in range(rounds):
            for s in range(m):
                other = along - alongs[s][rows, codes[:, s]]
                codes[:, s] = (errors[s] + (ANISOTROPY - 1) * (other[:, None] + alongs[s]) ** 2).argmin(1)
                along = other + alongs[s][rows, codes[:, s]]
        return codes.astype(np.uint8)

    def rests(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors what the codes leave: its part along the vector and the length of the rest."""
        left = self.parts(x) - self.books[np.arange(codes.shape[1]), codes]
        along = (left * self.parts(x)).sum(axis=(1, 2))
        return along, np.sqrt(np.maximum((left**2).sum(axis=(1, 2)) - along**2, 0))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Per query and subspace the inner products with the 16 centres."""
        return np.einsum("qsd,scd->qsc", self.parts(queries), self.books).astype(np.float32)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return even[:, ::2] | even[:, 1::2] << 4


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, rows) from packed codes, two look-ups at a time.

    Each pair of subspaces has a joint table of 256 sums, which its packed byte addresses.
    """
    q, m, _ = tables.shape
    if m % 2:
        tables = np.concatenate([tables, np.zeros((q, 1, CENTRES), np.float32)], axis=1)
    out = np.zeros((packed.shape[0], q), np.float32)
    for s in range(packed.shape[1]):
        low, high = tables[:, 2 * s], tables[:, 2 * s + 1]
        joint = (high[:, :, None] + low[:, None, :]).reshape(q, 256).T.copy()
        out += joint[packed[:, s]]
    return out.T


def select(approx: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest, ties to the earlier place."""
    if len(approx) <= k:
        return np.arange(len(approx))
    edge = np.partition(approx, len(approx) - k)[len(approx) - k]
    above = np.flatnonzero(approx > edge)
    return np.concatenate([above, np.flatnonzero(approx == edge)[: k - len(above)]])


def least(score: np.ndarray, along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """The least approximate products (queries, rows) with which a row's cosine can reach each query's ``score``.

    For unit vectors q and u, where u's codes leave r = along u + rest: <q, u> = approx + along <q, u> + <q, rest>, and
    |<q, rest>| <= across sqrt(1 - <q, u>^2). So approx >= t (1 - along) - across sqrt(1 - t^2), which grows with t from 0 on.
    """
    t = np.minimum(score, 1.0)
    edge = np.outer(t, 1 - along) - np.outer(np.sqrt(np.maximum(1 - t**2, 0)), across) - 1e-5  # scans are in single precision
    edge[~(t > 0)] = -np.inf
    edge[:, along >= 1] = -np.inf
    return edge.astype(np.float32)


def exact(q: np.ndarray, q_norm: float, vecs: np.ndarray, norms: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows ``at`` (in order of ids) the k of largest cosine, ties to the smaller id, and their cosines."""
    score = np.einsum("nd,d->n", vecs[at], q) / (norms[at] * q_norm)
    top = np.lexsort((ids[at], -score))[:k]
    return at[top], score[top]


def chunk_nearest(coder: Quantiser, q: np.ndarray, vecs: np.ndarray, codes: np.ndarray, rests: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k nearest of a chunk (places, cosines), exactly: the RERANK best by codes set a bar, and every row that
    can still reach it is scored too; where those are many, in one product for all such queries."""
    norms, q_norm = np.linalg.norm(vecs, axis=1), np.linalg.norm(q, axis=1)
    approx = scan(coder.tables(q / q_norm[:, None]), codes)
    out = [exact(q[r], q_norm[r], vecs, norms, ids, select(approx[r], RERANK), k) for r in range(len(q))]
    if len(ids) <= RERANK:
        return out
    bar = np.array([score[-1] if len(score) == k else -1.0 for _, score in out])
    able = approx >= least(bar, *rests)
    count = able.sum(axis=1)
    many = np.flatnonzero(count > len(ids) // 16)
    for r in np.flatnonzero((count <= len(ids) // 16) & (count > 0)):
        out[r] = exact(q[r], q_norm[r], vecs, norms, ids, np.union1d(np.flatnonzero(able[r]), out[r][0]), k)
    if len(many):
        score = (q[many] @ vecs.T) / norms / q_norm[many, None]
        for row, r in zip(score, many):
            edge = np.partition(row, len(row) - k)[len(row) - k] - 1e-12 if len(row) > k else -np.inf
            out[r] = exact(q[r], q_norm[r], vecs, norms, ids, np.flatnonzero(row >= edge), k)
    return out


class Cells:
    """Centres of cells (unit vectors), each one's share of the vectors and the number of cells that a query probes."""

    def __init__(self, x: np.ndarray, n_rows: int, k: int, seed: int = 9, drawn: np.ndarray | None = None, asked: np.ndarray | None = None):
        """x: the sample's unit vectors, copies once; drawn: with copies; asked: unit vectors of queries, else some of x stand for them."""
        rng = np.random.default_rng(seed)
        n = int(np.clip(min(n_rows // CELL_ROWS, len(x) // 8), 1, MOST_CELLS))
        self.centres = x[rng.choice(len(x), n, replace=False)]
        for _ in range(8):
            own = self.of(x)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centres = np.where(size > 0, sums / np.maximum(size, 1e-300), self.centres)
        own = self.of(x)
        share = (np.bincount(own if drawn is None else self.of(drawn), minlength=n) + 1) / (len(x if drawn is None else drawn) + n)
        self.parts = np.maximum(1, np.ceil(share * n_rows / CHUNK)).astype(np.int64)
        self.bins = Bins(self.parts)
        self.probes = n
        if n > 1:
            asked = x[rng.choice(len(x), min(PROBED, len(x)), replace=False)] if asked is None else asked
            met = in_blocks(lambda q: self._met(x, own, q, k), asked, 64)
            self.probes = int(np.quantile(met, CELL_RECALL, method="higher")) + 1

    def _met(self, x: np.ndarray, own: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
        """How many cells are nearer to queries than those of their neighbours."""
        near = -(asked @ x.T)
        near[near < 1e-12 - 1] = np.inf  # a query's own vector
        top = np.argpartition(near, min(k, len(x) - 1) - 1, axis=1)[:, :k]
        order = self.nearest(asked, len(self.centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(asked), 0), axis=1)
        return np.take_along_axis(place, own[top], axis=1)

    def of(self, x: np.ndarray) -> np.ndarray:
        return in_blocks(lambda rows: (rows @ self.centres.T).argmax(axis=1), x)

    def floor(self, x: np.ndarray) -> np.ndarray:
        """For each row the inner product with the last centre that it probes."""
        at = len(self.centres) - self.probes
        return in_blocks(lambda rows: np.partition(rows @ self.centres.T, at, axis=1)[:, at], x) - 1e-9

    def probed(self, x: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """For each row the cells that it probes (rows, cells)."""
        return x @ self.centres.T >= floor[:, None]

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :n]


def unit(vecs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    v = np.stack(vecs.to_numpy())
    return v, v / np.linalg.norm(v, axis=1, keepdims=True)


def narrow(v: np.ndarray) -> np.ndarray:
    """As single precision where that holds the values exactly."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return single if (single == v).all() else v


def bytes_of(v: np.ndarray) -> list[bytes]:
    """Each row's bytes, narrow where all rows are."""
    return [row.tobytes() for row in narrow(v)]


def rows_of(held: pd.Series, dim: int) -> np.ndarray:
    """Back from ``bytes_of``: rows of eight or four bytes a component."""
    wide = held.str.len().to_numpy() == 8 * dim
    out = np.empty((len(held), dim))
    for kind, at in ((np.float64, wide), (np.float32, ~wide)):
        if at.any():
            out[at] = np.frombuffer(b"".join(held[at]), kind).reshape(-1, dim)
    return out


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and vec (array<double>) of the vectors that take part, and their number."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where("vec_id is not null and vec is not null").where(~F.exists("vec", odd))
    rows = rows.where(F.exists("vec", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0].n if sizes else 0)), sizes[0]["count"] if sizes else 0


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that ``is_query`` (over vec_id)."""
    rows, n_rows = usable(vectors)
    # about twice the sample passes the filter, so that each task sends few rows to be ordered
    share = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 20)) < (1 << 20) * min(1.0, 2 * FIT_ROWS / max(1, n_rows))
    sample = rows.where(share).orderBy(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 20)), F.xxhash64("vec_id", "vec"), "vec_id").limit(FIT_ROWS).select("vec").toPandas()["vec"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = unit(sample)[1]
    x, dim = np.unique(drawn, axis=0), drawn.shape[1]  # copies would take the centres
    del sample
    # queries may lie elsewhere than the rows: they measure how many cells to probe
    drawn_by = F.xxhash64(F.lit(7), "vec_id", "vec")
    queries = rows.where(is_query).select("vec", drawn_by.alias("h")).orderBy("h").limit(PROBED).select("vec").toPandas()["vec"]
    asked = unit(queries)[1] if len(queries) else None
    model = spark.sparkContext.broadcast((Quantiser.fit(x), Cells(x, n_rows, k, drawn=drawn, asked=asked)))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = model.value[1]
        parts = cells.parts
        for pdf in batches:
            v, u = unit(pdf["vec"])
            cell = cells.of(u)
            mixed = pdf["vec_id"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            yield pdf.assign(vec=bytes_of(v), cell=cell, part=(mixed % parts[cell].astype(np.uint64)).astype(np.int64))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, cells = model.value

        def chunk(cell: int, number: int, held: list[pd.DataFrame]) -> pd.DataFrame:
            part = pd.concat(held).sort_values("vec_id", kind="stable")
            v = rows_of(part["vec"], dim)
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            # of equal vectors, only the k + 2 least vec_ids of a chunk can be among the k nearest
            same = pd.Series([row.tobytes() for row in v + 0.0])
            able = (same.groupby(same, sort=False).cumcount() <= k + 1).to_numpy()
            ids, v, codes = part["vec_id"].to_numpy(np.int64)[able], v[able], coder.encode(u[able])
            rests = np.stack(coder.rests(u[able], codes))
            return pd.DataFrame({"bin": [int(cells.bins.of(cell, number))], "cell": [cell], "n": [len(ids)], "ids": [ids.tobytes()], "vecs": [narrow(v).tobytes()], "codes": [pack(codes).tobytes()], "rests": [rests.tobytes()]})

        at, held, size = None, [], 0
        for pdf in batches:
            for key, part in pdf.groupby(["cell", "part"], sort=True):
                for i in range(0, len(part), CHUNK):
                    piece = part.iloc[i : i + CHUNK]
                    if held and (key != at or size + len(piece) > CHUNK):
                        yield chunk(*map(int, at), held)
                        held, size = [], 0
                    at = key
                    held.append(piece)
                    size += len(piece)
        if held:
            yield chunk(*map(int, at), held)

    in_cells = rows.mapInPandas(placed, "vec_id long, vec binary, cell int, part int")
    chunks = in_cells.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInPandas(index, "bin int, cell int, n int, ids binary, vecs binary, codes binary, rests binary")

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each bin with cells that a query probes; home, its nearest cell, keeps like queries together."""
        cells = model.value[1]
        within = np.zeros((len(cells.centres), cells.bins.n), np.float32)
        for b, own in enumerate(cells.bins.cells()):
            within[own, b] = 1
        for pdf in batches:
            v, u = unit(pdf["vec"])
            query, to = np.nonzero(in_blocks(lambda rows: cells.probed(rows, cells.floor(rows)).astype(np.float32) @ within, u))
            yield pdf.assign(vec=bytes_of(v), home=cells.of(u)).iloc[query].assign(bin=to)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries of a bin together, at most QUERY_BLOCK, with the bin's cells that one of them probes; rows come sorted by bin and home."""
        cells = model.value[1]
        owned = cells.bins.cells()
        for pdf in batches:
            for b, part in pdf.groupby("bin", sort=True):
                for i in range(0, len(part), QUERY_BLOCK):
                    own = part.iloc[i : i + QUERY_BLOCK]
                    v = rows_of(own["vec"], dim)
                    u = v / np.linalg.norm(v, axis=1, keepdims=True)
                    floor = cells.floor(u)
                    met = cells.probed(u, floor).any(axis=0)
                    yield pd.DataFrame({"bin": [int(b)], "cells": [owned[b][met[owned[b]]]], "q_ids": [own["vec_id"].to_numpy(np.int64).tobytes()], "q_keys": [own["key"].to_numpy(np.int64).tobytes()],
                                        "q_vecs": [narrow(v).tobytes()], "floor": [floor.tobytes()]})

    asked = rows.where(is_query).select("vec_id", F.xxhash64("vec").alias("key"), "vec").dropDuplicates(["vec_id", "key"])
    asked = asked.mapInPandas(probing, "vec_id long, key long, vec binary, home int, bin int")
    blocks = asked.repartition("bin").sortWithinPartitions("bin", "home").mapInPandas(block, "bin int, cells array<int>, q_ids binary, q_keys binary, q_vecs binary, floor binary")

    def held(data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, np.float64 if len(data) == 8 * n * dim else np.float32).reshape(n, dim).astype(np.float64)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, cells = model.value
        for pdf in batches:
            for cell, n, ids, vecs, codes, rests, q_ids, q_keys, q_vecs, floor in zip(*(pdf[c] for c in ("cell", "n", "ids", "vecs", "codes", "rests", "q_ids", "q_keys", "q_vecs", "floor"))):
                ids, vecs = np.frombuffer(ids, np.int64), held(vecs, n)
                codes = np.frombuffer(codes, np.uint8).reshape(n, -1)
                q_ids, q_keys = np.frombuffer(q_ids, np.int64), np.frombuffer(q_keys, np.int64)
                q = held(q_vecs, len(q_ids))
                probing = q / np.linalg.norm(q, axis=1, keepdims=True) @ cells.centres[cell] >= np.frombuffer(floor)  # others of the block may not
                if not probing.any():
                    continue
                q_ids, q_keys, q = q_ids[probing], q_keys[probing], q[probing]
                rests = np.frombuffer(rests).reshape(2, -1)
                out = []
                for a in range(0, len(q_ids), 256):
                    for r, (at, score) in enumerate(chunk_nearest(coder, q[a : a + 256], vecs, codes, rests, ids, k + 1), a):
                        own = (ids[at] == q_ids[r]) & (vecs[at] == q[r]).all(axis=1)
                        out.append((np.full(len(at), q_ids[r]), np.full(len(at), q_keys[r]), ids[at], score, own))
                yield pd.DataFrame(dict(zip(("query_id", "key", "vec_id", "score", "own"), map(np.concatenate, zip(*out)))))

    # a bin's chunks are held while its blocks pass
    pairs = blocks.join(chunks, "bin").where(F.array_contains("cells", F.col("cell"))).drop("bin", "cells")
    found = pairs.mapInPandas(search, "query_id long, key long, vec_id long, score double, own boolean")
    # the query's own row goes, once
    mine = Window.partitionBy("query_id", "key", "own").orderBy(F.desc("score"), "vec_id")
    others = found.withColumn("copy", F.row_number().over(mine)).where((F.col("copy") <= k + 1) & ~(F.col("own") & (F.col("copy") == 1)))
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings``: the 5 nearest of every row whose vec_id is divisible by 50."""
    return nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


QUERIES = {"op3_ann": op3_ann}
ORACLE_SQL: dict[str, str] = {}
