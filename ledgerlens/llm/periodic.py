"""Periodic runs of words by a harmonic grid with suffix arrays.

A run is a stretch of consecutive words with smallest period q and at least
``least_words`` and ``powers`` * q words that no neighbouring word extends. For
each period p, a run of that period covers several neighbours of the grid 0, p,
2p, ...; from such a pair jp and (j+1)p the longest common extension forward (of
the text) and backward (of the reversed text) gives its two ends. Extensions are
minima of LCP arrays: suffix arrays come by prefix doubling of what is still
tied, LCPs from irreducible positions only, minima from a table over blocks. The
grid of a text of n words has n ln n pairs; where the words of ``powers``
neighbouring grid points differ no run of that period starts, and no extension
is asked for. Of equal stretches the least period stays.

Texts are independent: no shuffle, no group. A task works on blocks of
BLOCK_WORDS words, a longer text by itself, and on PAIRS grid pairs at once, so
its memory grows with the longest text only.

Edge cases: a null or empty text has no words, no runs and an empty collapsed
text. Repeated rows and rows without doc_id are answered each. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST_WORDS, POWERS = 6, 4
BLOCK_WORDS = 300_000
PAIRS = 1 << 20
#: Entries of a block of the table of minima.
MINIMA = 16


def suffix_order(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, document by document, and each one's place. ``ends``: where the position's document ends."""
    n = len(codes)
    slots, known = np.arange(n), 0
    order, rank, key = slots.copy(), np.zeros(n, np.int64), doc.astype(np.int64) << 32 | codes
    while len(slots):
        at = order[slots]
        if known:
            then = at + known
            key = rank[at] * (n + 1) + np.where(then < ends[at], rank[np.minimum(then, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        head = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        slots = slots[~(head & np.append(head[1:], True))]
        known = 2 * known or 1
    return order, rank


def common_prefixes(codes: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in order.

    Where the words before both are equal, the LCP is one less than that of the
    position before; only the others are compared, in windows that widen.
    """
    n = len(codes)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    paired = (before >= 0) & (doc[before] == doc)
    derived = paired & (here > starts) & (before > starts[before]) & (codes[here - 1] == codes[before - 1])
    length, active = np.zeros(n, np.int64), np.flatnonzero(paired & ~derived)
    while len(active):
        width = int(np.clip(65536 // len(active), 1, 4096))
        x = (active + length[active])[:, None] + np.arange(width)
        y = (before[active] + length[active])[:, None] + np.arange(width)
        end = ends[active][:, None]
        same = (x < end) & (y < end) & (codes[np.minimum(x, n - 1)] == codes[np.minimum(y, n - 1)])
        whole = same.all(axis=1)
        length[active] += np.where(whole, width, same.argmin(axis=1))
        active = active[whole]
    root = np.maximum.accumulate(np.where(derived, 0, here))
    return (length[root] - (here - root))[order]


class Minima:
    """Minima of ranges of an array: by entry inside blocks of MINIMA entries, by powers of two over blocks."""

    def __init__(self, values: np.ndarray):
        pad = -len(values) % MINIMA
        blocks = np.pad(values, (0, pad), constant_values=np.iinfo(np.int64).max).reshape(-1, MINIMA)
        self.values = blocks.ravel()
        self.left = np.minimum.accumulate(blocks, axis=1).ravel()
        self.right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while 2 ** len(self.levels) <= len(blocks):
            half, last = 2 ** (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))
        self.table = np.zeros((len(self.levels), len(blocks)), np.int64)
        for k, level in enumerate(self.levels):
            self.table[k, : len(level)] = level

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of low..high, both included."""
        a, b = low // MINIMA, high // MINIMA
        out = np.minimum(self.right[low], self.left[high])
        far = np.flatnonzero(b - a > 1)
        if len(far):
            first, n = a[far] + 1, b[far] - a[far] - 1
            k = np.frexp(n.astype(np.float64))[1] - 1
            out[far] = np.minimum(out[far], np.minimum(self.table[k, first], self.table[k, first + n - (1 << k)]))
        near = np.flatnonzero(a == b)
        if len(near):
            at = np.minimum(low[near, None] + np.arange(MINIMA), high[near, None])
            out[near] = self.values[at].min(axis=1)
        return out


class Extensions:
    """Longest common extensions of pairs of positions x < y of one document."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        order, self.rank = suffix_order(codes, doc, ends)
        self.least = Minima(common_prefixes(codes, doc, starts, ends, order))

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self.rank[x], self.rank[y]
        return self.least.of(np.minimum(a, b) + 1, np.maximum(a, b))


def grid(codes: np.ndarray, offsets: np.ndarray, powers: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of the grid points from which ``powers`` neighbours hold the same word, PAIRS looked at at once."""
    sizes = np.diff(offsets)
    periods = sizes // powers
    base = np.repeat(offsets[:-1], periods)
    p = np.arange(len(base)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    upto = np.cumsum((np.repeat(sizes, periods) - 1) // p - powers + 2)  # grid pairs up to each period of each document
    for low in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
        high = min(low + PAIRS, int(upto[-1]))
        a, b = np.searchsorted(upto, (low, high - 1), side="right")
        before = np.append(0, upto)[a : b + 1]
        which = np.repeat(np.arange(a, b + 1), np.minimum(upto[a : b + 1], high) - np.maximum(before, low))
        step = p[which]
        x = base[which] + (np.arange(low, high) - before[which - a]) * step
        for k in range(1, powers):
            same = codes[x] == codes[x + k * step]
            x, step = x[same], step[same]
        if len(x):
            yield x, step


def runs_of(codes: np.ndarray, sizes: np.ndarray, least_words: int = LEAST_WORDS, powers: int = POWERS) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, sorted; ``codes``: the documents' words as numbers, end to end."""
    offsets = np.append(0, np.cumsum(sizes))
    out, asked = np.zeros((0, 4), np.int64), np.zeros(len(sizes), bool)
    for x, _ in grid(codes, offsets, powers):
        asked[np.searchsorted(offsets, x, side="right") - 1] = True
    if not asked.any():
        return out
    # only the documents that have such grid points, end to end
    some = np.flatnonzero(asked)
    own_offsets = np.append(0, np.cumsum(sizes[some]))
    codes = codes[np.repeat(asked, sizes)]
    doc, n = np.repeat(np.arange(len(some)), sizes[some]), len(codes)
    starts, ends = own_offsets[doc], own_offsets[doc + 1]
    forth = Extensions(codes, doc, starts, ends)
    back = Extensions(codes[::-1], doc[::-1], n - ends[::-1], n - starts[::-1])
    for x, q in grid(codes, own_offsets, powers):
        low, high = x.copy(), x + q + forth.of(x, x + q)
        inside = x > starts[x]
        low[inside] -= back.of(n - x[inside], n - x[inside] - q[inside])
        long = high - low >= np.maximum(least_words, powers * q)
        out = np.concatenate([out, np.stack([doc[x], low, high - low, q], axis=1)[long]])
        out = out[np.lexsort(out.T[::-1])]  # of equal stretches the least period comes first
        out = out[np.append(True, (out[1:, :3] != out[:-1, :3]).any(axis=1))] if len(out) else out
    out[:, 1] -= own_offsets[out[:, 0]]
    out[:, 0] = some[out[:, 0]]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _block(texts: list[list[bytes]], least_words: int, powers: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Of each text its runs (start, length, period) and its words without repeats, joined."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.empty(int(sizes.sum()), object)
    words[:] = [w for t in texts for w in t]
    found = runs_of(pd.factorize(words)[0].astype(np.int64), sizes, least_words, powers)
    cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    runs, rest = [], []
    for own, a, b in zip(texts, cuts, cuts[1:]):
        runs.append(found[a:b, 1:])
        if a < b:
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, found[a:b, 1] + found[a:b, 3], 1)
            np.add.at(edge, found[a:b, 1] + found[a:b, 2], -1)
            own = [own[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
        rest.append(b" ".join(own))
    return runs, rest


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, powers: int = POWERS) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period) and collapsed of every row.

    ``collapsed``: the words but those that a run contains after its first period, joined by one space.
    """
    if powers < 2:
        raise ValueError("a run has at least two periods")

    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs, rest = _block(texts, least_words, powers)
        flat = np.concatenate(runs)
        parts = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], ["start", "length", "period"])
        places = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(places, parts), pa.array(rest, pa.binary())], ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()  # at the same bytes as [\x20\x09-\x0D]
                if texts and held + len(words) > BLOCK_WORDS:
                    yield answer(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
            if texts:
                yield answer(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The text, and for a tenth of the doc_ids (by CRC-32) its words with a tail of repeats of one stretch."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # the arrays of one entry bind what the functions read several times
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.get(F.transform(F.array(words), tail), 0)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: number of runs, the longest run, digests of the runs and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("text"), F.col("doc_id")).alias("text"))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = periodic_runs(docs).withColumn("best", best).withColumn("lines", F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
