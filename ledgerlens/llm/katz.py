"""Language-model scores by Katz backoff with Good-Turing discounts.

A count r of at most K is discounted by Good-Turing's d_r, computed from the
counts of counts of its order; where these give no discounts strictly between 0
and 1 (small corpora), the order takes absolute discounting with D = n1 / (n1 +
2 n2) instead. Larger counts are kept whole; only where a history has none of at
most K, so that nothing would be left for the unseen, each of its counts gives
up SPARE. With r* for a discounted count, h for a history and h' for the history
less its first word, P of order k is recursively

    P_k(w | h) = r* / c(h) for a seen n-gram, else alpha(h) P_(k-1)(w | h'),

with alpha(h) = (1 - sum of P_k(w | h)) / (1 - sum of P_(k-1)(w | h')) over the
words seen after h, alpha = 1 for an unknown history, P_1(w) = r* / N for a seen
word and one unknown type that has the rest. So each history's probabilities
sum to 1 over the V + 1 types.

Documents are cut into blocks of BLOCK_TOKENS tokens. For each order k, from 1 up,
a block sends its distinct n-grams, with their training counts, to the parts of
that order's table. A part merges what all blocks sent, stores its n-grams and
counts as the table (partitioned by order and part in the shared folder) and
answers each block: the counts, the n-grams' numbers, and for unseen n-grams the
sums from which alpha follows. The number of an n-gram is its place in its part
(frequent words first) and the part, so an n-gram of the next order is a pair of numbers, its history's
and its word's, and n-grams of one history meet in one part. When all orders are
answered, each block evaluates the recursion token by token.

No n-gram is a hot group: a block sends it once, however often it occurs. A
history with more than SPLIT tokens is spread over several parts by the next
word; sums of such histories (at most 2 / SHARE per order) are gathered and
broadcast. A part has about PART_KEYS n-grams and a task works on one part or one
block at a time, which bounds its memory. A stage's files are removed once the
next has read them.

Edge cases: a null or empty text has one token, the end. Repeated rows are
documents of their own. A long text fills a block by itself. Without training
documents N and V are 0 and the unknown type has probability 1. Extra columns
are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

ORDER = 3
K = 5
SPARE = 0.01
BLOCK_TOKENS = 1_000_000
PART_KEYS = 1_000_000
#: Histories of more tokens (or more than SHARE of all, so that few are) are spread over parts.
SPLIT = 250_000
SHARE = 2.0**-18
DOCS, KEYS, ANSWER, STATS, SPREAD, TABLE, BACKOFF = range(7)
ROW = "kind int, block long, ord int, part int, data binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]
END = 0
#: Bytes of rows that leave a task together.
FRAME_BYTES = 1 << 22

_zstd, _unzstd = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()


def hashes_of(words: Collection[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _planes(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes as the largest needs, first all lowest bytes, then the next."""
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    raw = np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)
    return bytes([width]) + raw.T.tobytes()


def _narrow(raw: bytes) -> np.ndarray:
    """What _planes packed, in as few bytes."""
    width = raw[0]
    x = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(x.T).view(f"<u{width}").reshape(-1)


def _whole(raw: bytes) -> np.ndarray:
    return _narrow(raw).astype(np.int64)


def _rises(x: np.ndarray) -> bytes:
    """Integers as differences, each by its sign in the lowest bit."""
    d = np.diff(x, prepend=0)
    return _planes(np.where(d < 0, -2 * d - 1, 2 * d))


def _risen(raw: bytes) -> np.ndarray:
    d = _whole(raw)
    return np.cumsum(np.where(d & 1, -(d >> 1) - 1, d >> 1))


def _pack(*fields: bytes) -> bytes:
    sizes = np.array([len(fields), *map(len, fields)], np.int64).tobytes()
    return _zstd.compress(sizes + b"".join(fields))


def _unpack(data: bytes) -> list[bytes]:
    raw = _unzstd.decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 * (count + 1) + np.cumsum([0, *np.frombuffer(raw, np.int64, count, 8)])
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES)


def _keyed(block: int, order: int, part: np.ndarray, *columns) -> pd.DataFrame:
    """KEYS rows: ``columns`` are (array, packer), cut by the ascending ``part``."""
    at = np.flatnonzero(np.diff(part, prepend=-1))
    cuts = [*at.tolist(), len(part)]
    rows = [(KEYS, block, order, int(part[a]), _pack(*(p(x[a:b]) for x, p in columns))) for a, b in zip(cuts, cuts[1:])]
    return _frame(rows)


def discounts(counts: dict[int, int]) -> list[float]:
    """d_1 .. d_K from the counts of counts 1 .. K + 1."""
    n = [0, *(counts.get(r, 0) for r in range(1, K + 2))]
    if n[1] and n[K + 1]:
        common = (K + 1) * n[K + 1] / n[1]
        if common < 1:
            found = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] else 0.0 for r in range(1, K + 1)]
            if all(0 < d < 1 for d in found):
                return found
    spare = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [(r - spare) / r for r in range(1, K + 1)]


@dataclass
class Model:
    """What the tasks of all orders need: sizes, discounts by order and the sums of spread histories."""

    parts: int
    split: int
    n: int = 0
    v: int = 0
    docs: int = 0
    unseen: float = 1.0
    #: No word occurs at most K times.
    closed: bool = False
    d: dict[int, np.ndarray] = field(default_factory=dict)
    #: order -> sorted histories, counts n_1 .. n_K and n_(>K), lower sums
    spread: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def star(self, order: int, c: np.ndarray, closed: np.ndarray | bool) -> np.ndarray:
        """Discounted counts; ``closed``: the history has no count of at most K."""
        return np.where(c <= K, c * self.d[order][np.minimum(c, K)], c - SPARE * closed)

    def learn(self, order: int, counts: dict[int, int]) -> None:
        self.d[order] = np.array([1.0, *discounts(counts)])
        if order == 1 and self.n:
            self.closed = not any(counts[r] for r in range(1, K + 1))
            left = SPARE * self.v if self.closed else sum(counts.get(r, 0) * r * (1 - self.d[1][r]) for r in range(1, K + 1))
            self.unseen = left / self.n


def _tokenise(parts: int):
    """Texts to blocks: a DOCS row and the words of the block as KEYS of order 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids, docs, doc_ids, held, size = _Ids(), [], [], [], 0

        def flush() -> pd.DataFrame:
            hashes = np.concatenate([np.zeros(1, np.uint64), hashes_of(ids)])
            part = (hashes % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((hashes, part))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            lengths = np.array([len(d) + 1 for d in docs])
            words = np.zeros(lengths.sum(), np.int64)  # END where nothing else stands
            inside = np.ones(len(words), bool)
            inside[np.cumsum(lengths) - 1] = False
            words[inside] = np.concatenate(docs)
            words = rank[words]
            # in the block's row, frequent words have small numbers; how often each stands there tells which number it has
            often = np.bincount(words, minlength=len(order))
            number = np.empty(len(order), np.int64)
            number[np.argsort(-often, kind="stable")] = np.arange(len(order))
            out = np.array(held, bool)
            token_out = np.repeat(out, lengths)
            n = np.bincount(words[~token_out], minlength=len(order))
            wanted = np.bincount(words[token_out], minlength=len(order)) > 0
            names = np.array([0 if i is None else i for i in doc_ids], np.int64), np.array([i is None for i in doc_ids])
            head = _pack(names[0].tobytes(), _planes(names[1]), _planes(out), _planes(lengths), _planes(number[words]), _planes(often))
            sent = _keyed(base + seq, 1, part[order], (hashes[order], np.ndarray.tobytes), (n, _planes), (wanted, _planes))
            return pd.concat([_frame([(DOCS, base + seq, 0, -1, head)]), sent])

        for pdf in batches:
            for doc_id, text, out in zip(pdf["doc_id"], pdf["text"], pdf["held"]):
                found = words_of(text)
                docs.append(np.fromiter(map(ids.__getitem__, found), np.int64, len(found)))
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                held.append(bool(out))
                size += len(found) + 1
                if size >= BLOCK_TOKENS:
                    yield flush()
                    seq += 1
                    ids, docs, doc_ids, held, size = _Ids(), [], [], [], 0
        if docs:
            yield flush()

    return run


def _by(batches: Iterator[pd.DataFrame], name: str) -> Iterator[list[tuple]]:
    """The rows of each block or part in turn; rows come sorted."""
    at, held = None, []
    place = NAMES.index(name)
    for pdf in batches:
        for row in pdf[NAMES].itertuples(index=False, name=None):
            if held and row[place] != at:
                yield held
                held = []
            at = row[place]
            held.append(row)
    if held:
        yield held


def _answer(order: int, last: bool, sent):
    """KEYS of a part to a TABLE row, the blocks' ANSWER rows, STATS and the sums of SPREAD histories."""

    def merge(rows: list[tuple]) -> Iterator[tuple]:
        model, part = sent.value, rows[0][3]
        fields, sizes = [_unpack(r[4]) for r in rows], []

        def column(k: int, read=_narrow) -> np.ndarray:
            parts = [read(f[k]) for f in fields]
            sizes[:] = map(len, parts)
            for f in fields:
                f[k] = b""
            return np.concatenate(parts)

        n, wanted = column(-2), column(-1) > 0
        if order == 1:
            names, at = np.unique(column(0, lambda raw: np.frombuffer(raw, np.uint64)), return_inverse=True)
            # frequent words first: small numbers, in few bytes
            order_ = np.argsort(-np.bincount(at, n, len(names)), kind="stable")
            place = np.empty(len(names), np.int64)
            place[order_] = np.arange(len(names))
            names, at = names[order_], place[at]
        else:
            lower, spread = column(4), column(5) > 0
            code = column(0, _risen) * model.parts + column(1)
            words, histories = column(2).astype(np.int64) * model.parts + column(3), None
            wide = int(words.max()) + 1
            if (int(code.max()) + 1) * wide >= 1 << 62:
                histories, code = np.unique(code, return_inverse=True)
            code *= wide
            code += words
            del words
            names, at = np.unique(code, return_inverse=True)
            del code
            h, w = names // wide, names % wide
            h = h if histories is None else histories[h]
        c = np.bincount(at, n, len(names)).astype(np.int64)
        out = np.zeros(len(names), bool)
        out[at[wanted]] = True
        stats = [int((c == r).sum()) for r in range(1, K + 2)]
        closed, sums, hist = np.zeros(len(names), bool), None, None
        if order == 1:
            stats += [int(c.sum()), int((c > 0).sum()), int(c[names == END].sum())]
        else:
            seen = c > 0
            table_ = _pack(_rises(h[seen] // model.parts), _planes(h[seen] % model.parts), _planes(w[seen] // model.parts), _planes(w[seen] % model.parts), _planes(c[seen]))
            low = np.zeros(len(names), np.int64)
            low[at[lower > 0]] = lower[lower > 0]
            own = np.zeros(len(names), bool)
            own[at[spread]] = True
            start = np.diff(h, prepend=-1) != 0
            hist = np.cumsum(start) - 1
            size = int(hist[-1]) + 1
            kind = np.minimum(c, K + 1)
            sums = np.stack([np.bincount(hist, kind == r, size) for r in range(1, K + 2)], axis=1).astype(np.int64)
            below = np.bincount(hist, np.where((c > 0) & (low > 0), model.star(order - 1, low >> 1, low & 1), 0.0), size)
            closed = ((sums[:, :K].sum(axis=1) == 0) & (sums[:, K] > 0))[hist]
            shared = own[start] & (sums.sum(axis=1) > 0)
            if shared.any():
                yield SPREAD, 0, order, part, _pack(h[start][shared].tobytes(), sums[shared].tobytes(), below[shared].tobytes())
        yield TABLE, 0, order, part, table_ if order > 1 else _pack(names[c > 0].tobytes(), _planes(c[c > 0]))
        yield STATS, 0, order, part, np.array(stats, np.int64).tobytes()
        flags = closed.astype(np.int64) + 2 * (out & (not last))
        for row, own_at in zip(rows, np.split(at, np.cumsum(sizes)[:-1])):
            # the last order's n-grams need no numbers
            answer = [_planes(c[own_at]), b"" if last else (_planes if order == 1 else _rises)(own_at), _planes(flags[own_at])]
            yield ANSWER, row[1], order, part, _pack(*answer)
            if order > 1 and len(lost := own_at[c[own_at] == 0]):
                yield BACKOFF, row[1], order, part, _pack(*(_planes(sums[hist[lost], r]) for r in range(K + 1)), below[hist[lost]].tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _by(batches, "part"):
            held, size = [], 0
            for row in merge(rows):
                held.append(row)
                size += len(row[4])
                if size > FRAME_BYTES:
                    yield _frame(held)
                    held, size = [], 0
            yield _frame(held)

    return run


class _Block:
    """The tokens of a block and what the tables know of their n-grams, order by order."""

    def __init__(self, model: Model, rows: list[tuple]):
        self.model, self.block = model, rows[0][1]
        head = _unpack(rows[0][4])
        nulls, self.held, self.lengths, words, often = map(_whole, head[1:])
        words = np.argsort(-often, kind="stable")[words]
        self.doc_ids = [None if x else int(i) for i, x in zip(np.frombuffer(head[0], np.int64), nulls)]
        self.train = np.repeat(self.held == 0, self.lengths)
        ends = np.cumsum(self.lengths)
        self.first = np.concatenate([[0], ends[:-1]])
        #: of each order: the n-gram of each token, and each n-gram's count, number, flags, a token of it and history's count
        self.inv, self.c, self.gid, self.closed, self.wanted, self.some, self.total, self.alpha = ({} for _ in range(8))
        self.inv[1] = words
        for order in range(1, 1 + max(r[2] for r in rows)):
            if order > 1:
                self.keys(order)
            own = [r for r in rows if r[2] == order]
            self.read(order, *([_unpack(r[4]) for r in own if r[0] == kind] for kind in (ANSWER, BACKOFF)), [r[3] for r in own if r[0] == ANSWER])

    def keys(self, order: int) -> None:
        """Finds the block's distinct n-grams, sorted by part, history and word, from the order below."""
        model, lower = self.model, order - 1
        names, counts = np.concatenate([[0], self.gid[lower] + 1]), np.concatenate([[model.docs], self.c[lower]])
        before = np.empty(len(self.inv[1]), np.int64)
        before[1:] = self.inv[lower][:-1] + 1
        before[self.first] = 0
        by_gid = np.argsort(self.gid[1])
        rank = np.empty(len(by_gid), np.int64)
        rank[by_gid] = np.arange(len(by_gid))
        # histories stand in their own part; a spread one stands in several, by the word
        several = -(-counts // model.split)
        pair, home = before, names % model.parts
        at = np.flatnonzero(several[before] > 1)
        owner = np.arange(len(names))
        if len(at):
            h = before[at]
            mixed = (self.gid[1][self.inv[1][at]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = (home[h] + (mixed % several[h].astype(np.uint64)).astype(np.int64)) % model.parts
            made, place = np.unique(h * model.parts + part, return_inverse=True)
            pair = before.copy()
            pair[at] = len(names) + place
            owner, home = np.concatenate([owner, made // model.parts]), np.concatenate([home, made % model.parts])
        place = np.empty(len(owner), np.int64)
        ordered = np.lexsort((names[owner], home))
        place[ordered] = np.arange(len(owner))
        found, inv = np.unique(place[pair] * len(rank) + rank[self.inv[1]], return_inverse=True)
        some = np.empty(len(found), np.int64)
        some[inv] = np.arange(len(inv))
        owned = ordered[found // len(rank)]
        self.inv[order], self.some[order], self.total[order] = inv, some, counts[owner[owned]]
        self.sent = home[owned], names[owner[owned]], self.gid[1][by_gid[found % len(rank)]], owner[owned], several[owner[owned]] > 1

    def emit(self, order: int) -> pd.DataFrame:
        self.keys(order)
        part, before, words, owner, spread = self.sent
        parts = self.model.parts
        n = np.bincount(self.inv[order][self.train], minlength=len(part))
        out = np.bincount(self.inv[order][~self.train], minlength=len(part)) > 0
        below = self.inv[order - 1][self.some[order]]
        # the lower order's count and flag, for sums over histories that held-out documents ask for
        asked = np.concatenate([[True], self.wanted[order - 1]])[owner] & (n > 0)
        lower = np.where(asked, 2 * self.c[order - 1][below] + self.closed[order - 1][below], 0)
        # places and parts by themselves: places rise in small steps, and a history's part is mostly the row's own
        columns = (before // parts, _rises), (before % parts, _planes), (words // parts, _planes), (words % parts, _planes)
        return _keyed(self.block, order, part, *columns, (lower, _planes), (spread, _planes), (n, _planes), (out, _planes))

    def read(self, order: int, answers: list[list[bytes]], backoff: list[list[bytes]], parts: list[int]) -> None:
        """What the parts say of the block's n-grams; without the BACKOFF rows, which only scores need, no alpha."""
        model = self.model
        self.c[order] = np.concatenate([_whole(a[0]) for a in answers])
        if all(a[1] for a in answers):
            self.gid[order] = np.concatenate([(_whole if order == 1 else _risen)(a[1]) * model.parts + p for a, p in zip(answers, parts)])
        flags = np.concatenate([_whole(a[2]) for a in answers])
        self.closed[order], self.wanted[order] = flags & 1, flags > 1
        if order == 1:
            self.closed[order] = np.full(len(flags), int(model.closed))
            return
        c, total = self.c[order], self.total[order]
        lost = np.flatnonzero(c == 0)
        none = [np.zeros(0)]
        sums = np.stack([np.concatenate([_whole(a[r]) for a in backoff] or none) for r in range(K + 1)], axis=1)
        below = np.concatenate([np.frombuffer(a[K + 1]) for a in backoff] or none)
        _, before, _, _, spread = self.sent
        if spread.any():
            names, every, lower = model.spread.get(order, (np.zeros(0, np.int64), np.zeros((0, K + 1), np.int64), np.zeros(0)))
            at = np.searchsorted(names, before)
            there = spread & (at < len(names))
            there[there] = names[at[there]] == before[there]
            closed = (every[:, :K].sum(axis=1) == 0) & (every[:, K] > 0)
            self.closed[order][there] = closed[at[there]]
            mine = there[lost] & bool(backoff)
            if mine.any():
                sums, below = sums.copy(), below.copy()
                sums[mine], below[mine] = every[at[lost][mine]], lower[at[lost][mine]]
        if not backoff:
            self.alpha[order] = np.zeros(len(c))
            return
        # alpha of unseen n-grams whose history is known, as logarithms; 0 for the others
        left = sums[:, :K] @ (np.arange(1, K + 1) * (1 - model.d[order][1:]))
        left = np.where(sums[:, :K].sum(axis=1) == 0, SPARE * sums[:, K], left)
        known = (total[lost] > 0) & (left > 0)
        of_lower = np.full(len(lost), model.n) if order == 2 else self.total[order - 1][self.inv[order - 1][self.some[order][lost]]]
        value = np.zeros(len(lost))
        value[known] = np.log10(left[known] / total[lost][known]) - np.log10(1 - below[known] / of_lower[known])
        self.alpha[order] = np.zeros(len(c))
        self.alpha[order][lost] = value

    def scores(self, order: int) -> pd.DataFrame:
        """The recursion, for all tokens, from words up."""
        model, c1 = self.model, self.c[1]
        first = np.where(c1 > 0, model.star(1, c1, self.closed[1]) / max(model.n, 1), model.unseen)
        score = np.log10(first)[self.inv[1]]
        for k in range(2, order + 1):
            seen = self.c[k] > 0
            own = np.zeros(len(seen))
            own[seen] = np.log10(model.star(k, self.c[k][seen], self.closed[k][seen])) - np.log10(self.total[k][seen])
            score = np.where(seen[self.inv[k]], own[self.inv[k]], self.alpha[k][self.inv[k]] + score)
        base = (np.log10(c1 + 1.0) - np.log10(model.n + model.v + 1.0))[self.inv[1]]
        over = lambda x: np.add.reduceat(x, self.first)
        known = over((c1 > 0)[self.inv[1]].astype(np.int64))
        return pd.DataFrame({
            "doc_id": pd.array(self.doc_ids, "Int64"), "held_out": self.held > 0, "n_tokens": self.lengths, "n_known": known,
            "train_tokens": np.full(len(known), model.n), "base_score": over(base), "score": over(score),
        })


def _emit(order: int, sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _by(batches, "block"):
            yield _Block(sent.value, rows).emit(order)

    return run


def _score(order: int, sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _by(batches, "block"):
            yield _Block(sent.value, rows).scores(order)

    return run


def _learn(model: Model, order: int, answers: DataFrame) -> None:
    """Statistics and spread histories of an order: a row for each part, and at most 2 / SHARE histories."""
    rows = answers.where(F.col("kind").isin(STATS, SPREAD)).select("kind", "data").collect()
    stats = sum((np.frombuffer(r.data, np.int64) for r in rows if r.kind == STATS), np.zeros(K + 4 if order == 1 else K + 1, np.int64))
    counts = {r: int(stats[r - 1]) for r in range(1, K + 2)}
    if order == 1:
        model.n, model.v, model.docs = map(int, stats[K + 1 :])
    model.learn(order, counts)
    parts = [_unpack(r.data) for r in rows if r.kind == SPREAD]
    if parts:
        h = np.concatenate([np.frombuffer(f[0], np.int64) for f in parts])
        sums = np.concatenate([np.frombuffer(f[1], np.int64).reshape(-1, K + 1) for f in parts])
        names, at = np.unique(h, return_inverse=True)
        every, lower = np.zeros((len(names), K + 1), np.int64), np.zeros(len(names))
        np.add.at(every, at, sums)
        np.add.at(lower, at, np.concatenate([np.frombuffer(f[2]) for f in parts]))
        model.spread[order] = names, every, lower


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(spark: SparkSession, docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    about = (rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) / 6
    model = Model(parts=max(1, int(-(-about // PART_KEYS))), split=max(SPLIT, int(about * SHARE)))
    groups = max(2, int(-(-about // (4 * BLOCK_TOKENS))))
    found = materialize(spark, rows.mapInPandas(_tokenise(model.parts), ROW), "katz-blocks", by="kind")
    kept, keys, backoff = found.where(F.col("kind") == DOCS), found.where(F.col("kind") == KEYS), None
    for k in range(1, order + 1):
        sent = spark.sparkContext.broadcast(model)
        if k > 1:
            keys = kept.repartition(groups, "block").sortWithinPartitions("block", "ord", "part").mapInPandas(_emit(k, sent), ROW)
        merged = keys.repartition(model.parts, "part").sortWithinPartitions("part", "block").mapInPandas(_answer(k, k == order, sent), ROW)
        answers = materialize(spark, merged, f"katz-{k}", by="kind")
        if k == 1:
            discard(spark, found, f"kind={KEYS}")
        _learn(model, k, answers)
        kept = kept.unionByName(answers.where(F.col("kind") == ANSWER))
        if k > 1:
            own = answers.where(F.col("kind") == BACKOFF)
            backoff = own if backoff is None else backoff.unionByName(own)
    kept = kept if backoff is None else kept.unionByName(backoff)
    sent = spark.sparkContext.broadcast(model)
    return kept.repartition(groups, "block").sortWithinPartitions("block", "ord", "kind", "part").mapInPandas(_score(order, sent), OUT)


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(spark, table(spark, sf_dir, "documents"), held)


QUERIES = {"op8_katz": op8_katz}
ORACLE_SQL: dict[str, str] = {}
