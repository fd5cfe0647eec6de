"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are compared in lower case with each run of white space as one space. An
item is found in a document when some passage is within floor((1 - SIMILARITY) *
length) edits of it.

Item-sized windows stand at the words of a document (of LEAST_WORD characters at
least), one for each place an item's own words could be aligned to it. Items with
fewer windows than one in WINDOW_EVERY characters (short words or syllables, digits,
signs) have tables of their own, with windows at every word of item and document; that
second look at the documents is only taken where a block has such items. The CGK
random walk reads a window from there: at step j it puts out the character under
its pointer and moves on if a random bit of (j, character) says so, so that edits
of the text become differences at few steps of the walk, which falls back into
step with the unedited walk. Bit-sampling LSH draws SAMPLED of the first WALK
steps, anew for each of the REPETITIONS, and hashes what they put out. Walks of an
item's whole length agree too seldom at a fifth of the characters edited, which is
why bits are drawn from a walk's beginning; an item has a window at each of its
words, so a passage is met from all its places. WALK, SAMPLED and REPETITIONS are
set for a recall of 0.95 at the largest distance (measured in the tests).

What a window's first HEAD characters allow is looked up in one table for each
repetition, and at a few later steps the hash must be that of some item walk
(a bitmap); both drop most windows early and lose none. What collides names an
item and a window; windows of one item that overlap are one candidate, and its
exact edit distance (Myers' bit-vector search for the best passage in the window,
whole item) decides. Walks see classes of characters, the exact search characters.

Items are the small side: they are read in blocks of ITEM_BLOCK, each sent to
the executors by broadcast, one pass over the documents for each block.

Edge cases: null or blank documents and items match nothing; repeated items
match each for itself; items shorter than SHORT characters are searched for by
edit distance in whole documents; text without spaces has windows everywhere;
one row per row of documents and item, the best passage, ties to the earliest.
Very long documents are read in pieces that overlap by the largest window.
Extra columns are ignored. Rows with a null doc_id are compared like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIMILARITY = 0.8
REPETITIONS = 18
WALK = 29
#: Steps of a walk whose characters are hashed; which, is drawn anew for each repetition.
SAMPLED = 21
#: Every so many steps a walk moves on whatever its bits say.
STALL = 5
#: Classes of characters: the lowest five bits.
CLASSES = 32
#: Characters at a window's beginning that are looked up first.
HEAD = 4
#: After these steps windows whose hash begins no item walk are dropped, by bitmaps of 2^GATE_BITS.
GATES, GATE_BITS = (9, 13, 18, 23), 18
#: Windows begin at words of at least so many characters.
LEAST_WORD = 4
#: An item with fewer windows than one in so many characters gets windows at all its words.
WINDOW_EVERY = 20
#: Items of fewer characters are searched for whole, without walks.
SHORT = 48
#: In a run of more characters without a space windows stand at every character.
RUN = 16
ITEM_BLOCK = 2000
#: Characters whose windows are walked at once.
BATCH = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def as_bytes(text: str) -> np.ndarray:
    """A byte for each character; those beyond Latin-1 are hashed to the upper half."""
    try:
        return np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
    except UnicodeEncodeError:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return np.where(code < 256, code, 128 | (code * np.uint32(0x9E3779B1)) >> np.uint32(25)).astype(np.uint8)


def window_starts(chars: np.ndarray, least: int = LEAST_WORD) -> np.ndarray:
    """Places of words of at least ``least`` characters, and each place more than RUN characters into a run without a space."""
    if not len(chars):
        return np.zeros(0, np.int64)
    cuts = np.flatnonzero(chars == 32)
    starts, ends = np.concatenate([[0], cuts + 1]), np.append(cuts, len(chars))
    size = ends - starts
    long = np.flatnonzero(size > RUN)
    return np.concatenate([starts[size >= least], *(np.arange(starts[k] + RUN, ends[k]) for k in long)])


def short_hits(item: np.ndarray, budget: int, chars: np.ndarray) -> np.ndarray:
    """Places of ``chars`` where a passage within ``budget`` edits of ``item`` (at most 63 bytes) ends.

    Myers' search in many lanes of ``chars`` at once; lanes overlap by the longest passage. Bytes that several
    characters share can only add hits.
    """
    m, n = len(item), len(chars)
    lead = m + budget
    step = max(256, lead)
    first = np.arange(0, n, step)
    padded = np.concatenate([np.zeros(lead, np.uint8), chars, np.zeros(step, np.uint8)])
    one, full, top = np.uint64(1), np.uint64((1 << m) - 1), np.uint64(m - 1)
    eq = np.zeros(256, np.uint64)
    for i, c in enumerate(item):
        eq[c] |= one << np.uint64(i)
    pv, mv, score = np.full(len(first), full), np.zeros(len(first), np.uint64), np.full(len(first), m, np.int32)
    hits = []
    for j in range(lead + step):
        x = eq[padded[first + j]]
        xv = x | mv
        xh = (((x & pv) + pv) ^ pv) | x
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += ((ph >> top) & one).astype(np.int32) - ((mh >> top) & one).astype(np.int32)
        ph, mh = (ph << one) & full, (mh << one) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if j >= lead:
            hits.append(first[score <= budget] + j - lead)
    ends = np.concatenate(hits) + 1
    return np.sort(ends[ends <= n])


def best_passage(item: str, text: str, most: int) -> tuple[int, int, int]:
    """(distance, start, end) of the passage of ``text`` nearest to ``item``, the earliest end of ties; no start beyond ``most``."""

    def search(pattern: str, over: str) -> tuple[int, int]:
        m = len(pattern)
        full, top = (1 << m) - 1, 1 << (m - 1)
        eq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            eq[c] = eq.get(c, 0) | 1 << i
        pv, mv, score, best, end = full, 0, m, m, 0
        for j, c in enumerate(over):
            x = eq.get(c, 0)
            xv = x | mv
            xh = (((x & pv) + pv) ^ pv) | x
            ph, mh = mv | (full & ~(xh | pv)), pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = (ph << 1) & full, (mh << 1) & full
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
            if score < best:
                best, end = score, j + 1
        return best, end

    distance, end = search(item, text)
    if distance > most:
        return distance, end, end
    _, back = search(item[::-1], text[:end][::-1])
    return distance, end - back, end


class Walker:
    """The random bits of all repetitions: which character classes move the pointer at which step, and which steps count."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (REPETITIONS, WALK, CLASSES), dtype=np.int32)
        self.moves[:, STALL - 1 :: STALL] = 1  # no walk stands still for long
        self.sampled = np.array([np.isin(np.arange(WALK), rng.choice(WALK, SAMPLED, replace=False)) for _ in range(REPETITIONS)])

    def step(self, rep: int, j: int, c: np.ndarray, h: np.ndarray, pointer: np.ndarray) -> None:
        if self.sampled[rep, j]:
            h ^= c
            h *= _P
        pointer += self.moves[rep, j][c]

    def heads(self, rep: int, code: np.ndarray) -> np.ndarray:
        """The hash of each window's steps within its first HEAD characters, whose classes are packed in ``code``."""
        h, pointer = np.full(len(code), rep + 1, np.uint64), np.zeros(len(code), np.int32)
        for j in range(WALK):
            inside = np.flatnonzero(pointer < HEAD)
            if not len(inside):
                break
            at, own = pointer[inside], h[inside]
            self.step(rep, j, ((code[inside] >> (5 * at)) & 31).astype(np.uint8), own, at)
            h[inside], pointer[inside] = own, at
            h[inside[at >= HEAD]] ^= np.uint64(j << 8)  # how many steps it took counts as well
        return h


def head_codes(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The classes of the first HEAD characters of each window in one number."""
    code = np.zeros(len(starts), np.int32)
    for k in range(HEAD):
        code |= classes[starts + k].astype(np.int32) << (5 * k)
    return code


@dataclass
class Tables:
    """The walks of some items from their words of ``least`` characters: for each repetition the heads and gates that they pass, and sorted hashes with item and offset."""

    least: int
    heads: list[np.ndarray]
    gates: list[list[np.ndarray]]
    hashes: list[np.ndarray]
    item: list[np.ndarray]
    offset: list[np.ndarray]


@dataclass
class ItemIndex:
    """A block of items: tables of those with enough words of LEAST_WORD characters, of those that need windows at all their words, and the short ones."""

    ids: list
    texts: list[str]
    walker: Walker
    tables: list[Tables]
    short: list[int]


def _gate(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - GATE_BITS)).astype(np.int64)


def sparse_windows(text: str) -> bool:
    """Whether too few windows of a text stand at words of LEAST_WORD characters with WALK characters behind them."""
    chars = as_bytes(text)
    return int((window_starts(chars) <= len(chars) - WALK).sum()) * WINDOW_EVERY < len(chars)


def build_index(ids: list, texts: list[str], seed: int = 11) -> ItemIndex:
    walker = Walker(seed)
    whole = [i for i, t in enumerate(texts) if len(t) >= SHORT]
    dense = {i for i in whole if sparse_windows(texts[i])}
    parts = ((LEAST_WORD, [i for i in whole if i not in dense]), (1, sorted(dense)))
    tables = [build_tables(walker, texts, own, least) for least, own in parts if own]
    return ItemIndex(ids, texts, walker, tables, [i for i, t in enumerate(texts) if t and len(t) < SHORT])


def build_tables(walker: Walker, texts: list[str], own: list[int], least: int) -> Tables:
    """Tables of the items with the numbers ``own``."""
    out = Tables(least, [], [], [], [], [])
    whole = [(i, as_bytes(texts[i]) & 31) for i in own]
    flat = np.concatenate([np.concatenate([c, np.zeros(WALK + 1, np.uint8)]) for _, c in whole])
    base, starts, item, stop = 0, [], [], []
    for i, c in whole:
        at = window_starts(as_bytes(texts[i]), least)
        starts.append(at + base), item.append(np.full(len(at), i)), stop.append(np.full(len(at), base + len(c)))
        base += len(c) + WALK + 1
    starts, item, stop = map(np.concatenate, (starts, item, stop))
    first = np.cumsum([0, *(len(c) + WALK + 1 for _, c in whole)])[:-1]
    offset = starts - first[np.searchsorted(first, starts, side="right") - 1]
    every = np.arange(1 << (5 * HEAD), dtype=np.int32)
    for rep in range(REPETITIONS):
        h, pointer, gates = np.full(len(starts), rep + 1, np.uint64), starts.astype(np.int32), []
        for j in range(WALK):
            walker.step(rep, j, flat[pointer], h, pointer)
            if j + 1 in GATES:
                gates.append(h.copy())
        fits = pointer <= stop
        marks = []
        for g in gates:
            marks.append(np.zeros(1 << GATE_BITS, bool))
            marks[-1][_gate(g[fits])] = True
        order = np.argsort(h[fits], kind="stable")
        out.heads.append(np.isin(walker.heads(rep, every), walker.heads(rep, head_codes(flat, starts[fits]))))
        out.gates.append(marks)
        out.hashes.append(h[fits][order])
        out.item.append(item[fits][order])
        out.offset.append(offset[fits][order])
    return out


def candidates(walker: Walker, tables: Tables, classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, place in ``classes`` where the item would begin) of all collisions; ``classes`` ends in padding."""
    items, begins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    code = head_codes(classes, starts)
    for rep in range(REPETITIONS):
        start = starts[tables.heads[rep][code]].astype(np.int32)
        h, pointer = np.full(len(start), rep + 1, np.uint64), start.copy()
        gates = iter(tables.gates[rep])
        for j in range(WALK):
            walker.step(rep, j, classes[pointer], h, pointer)
            if j + 1 in GATES:
                keep = np.flatnonzero(next(gates)[_gate(h)])
                h, start, pointer = h[keep], start[keep], pointer[keep]
        low = np.searchsorted(tables.hashes[rep], h, side="left")
        count = np.searchsorted(tables.hashes[rep], h, side="right") - low
        hit = np.flatnonzero(count)
        n = count[hit]
        entry = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        items.append(tables.item[rep][entry])
        begins.append(np.repeat(start[hit].astype(np.int64), n) - tables.offset[rep][entry])
    return np.concatenate(items), np.concatenate(begins)


def matches(index: ItemIndex, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item number, distance, start, end): each item found in each normalized text."""
    budget = [int((1 - SIMILARITY) * len(t) + 1e-9) for t in index.texts]
    reach = 2 * max(map(len, index.texts), default=0)
    gap = np.zeros(WALK + 1, np.uint8)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def offer(doc: int, item: int, low: int, high: int) -> None:
        part = texts[doc][max(0, low) : high]
        distance, a, b = best_passage(index.texts[item], part, budget[item])
        found = (distance, max(0, low) + a, max(0, low) + b)
        if distance <= budget[item] and found < best.get((doc, item), (1 << 60, 0, 0)):
            best[doc, item] = found

    def pieces() -> Iterator[tuple[int, int, np.ndarray]]:
        for doc, text in enumerate(texts):
            chars = as_bytes(text)
            for at in range(0, max(1, len(chars)), BATCH):
                yield doc, at, chars[at : at + BATCH + reach]

    def flush(held: list) -> None:
        flat = np.concatenate([x for _, _, c in held for x in (c, gap)])
        bounds = np.cumsum([0, *(len(c) + len(gap) for _, _, c in held)])
        met = []
        for tables in index.tables:
            starts = np.concatenate([window_starts(c, tables.least) + b for (_, _, c), b in zip(held, bounds)])
            met.append(candidates(index.walker, tables, flat & 31, starts))
        item, begin = (np.concatenate(x) for x in zip(*met)) if met else (np.zeros(0, np.int64),) * 2
        if not len(item):
            return
        # the item may begin before its piece when an early part of it is missing
        piece = np.clip(np.searchsorted(bounds, begin + SHORT // 2, side="right") - 1, 0, len(held) - 1)
        order = np.lexsort((begin, item, piece))
        last = None
        for k in order:
            p, i, place = int(piece[k]), int(item[k]), int(begin[k])
            doc, at, _ = held[p]
            place += at - int(bounds[p])
            slack = budget[i]
            if last and last[:2] == (doc, i) and place - slack <= last[3] - len(index.texts[i]):
                last = (doc, i, last[2], place + len(index.texts[i]) + slack)
                continue
            if last:
                offer(*last)
            last = (doc, i, place - slack, place + len(index.texts[i]) + slack)
        if last:
            offer(*last)

    held, size = [], 0
    for doc, at, chars in pieces():
        held.append((doc, at, chars))
        size += len(chars)
        if size >= BATCH:
            flush(held)
            held, size = [], 0
    if held:
        flush(held)
    for doc, at, chars in pieces() if index.short else ():
        for i in index.short:
            last = -1
            size = len(index.texts[i]) + budget[i]
            for end in short_hits(as_bytes(index.texts[i]), budget[i], chars):
                # ends next to each other are one passage's; each gap starts another search
                if last >= 0 and end > last + 1:
                    offer(doc, i, at + begin, at + last)
                    last = -1
                if last < 0:
                    begin = int(end) - size
                last = int(end)
            if last >= 0:
                offer(doc, i, at + begin, at + last)
    for (doc, i), (distance, a, b) in sorted(best.items()):
        yield doc, i, distance, a, b


def _indexes(spark: SparkSession, items: DataFrame) -> Iterator[Broadcast]:
    """The index of each block of items."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    for block in range(blocks):
        own = items.groupBy("item_id", "text").count().where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        every = [(r.item_id, normal(r.text)) for r in own for _ in range(r["count"])]
        yield spark.sparkContext.broadcast(build_index([i for i, _ in every], [t for _, t in every]))


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, similarity, start, end (places in the normalized text)."""
    schema = "doc_id long, item_id long, distance int, similarity double, start long, end long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for sent in _indexes(spark, items):

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            own = sent.value
            for pdf in batches:
                ids = list(pdf["doc_id"])
                found = [
                    (ids[d], own.ids[i], dist, 1 - dist / len(own.texts[i]), a, b)
                    for d, i, dist, a, b in matches(own, [normal(t) for t in pdf["text"]])
                ]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "similarity", "start", "end"])

        part = texts.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows in whose text no item is found, each judged by its own text; columns as before, nothing is shuffled."""
    for sent in _indexes(spark, items):

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {d for d, *_ in matches(sent.value, [normal(t) for t in batch.column("text").to_pylist()])}
                yield batch.filter(pa.array([d not in bad for d in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against whole ``benchmark``: a row for each document and item found in it."""
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL: dict[str, str] = {}
