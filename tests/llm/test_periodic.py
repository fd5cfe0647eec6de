"""Periodic runs against a definition-by-definition search."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, powers=4):
    """Every stretch with its smallest period that can't be extended, by trying all periods at all places."""
    n, found = len(words), {}
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, powers * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def plain(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_a_plain_search(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        words = [rng.choice("abcdefg"[: rng.randrange(1, 7)]) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            at, part = rng.randrange(len(words) + 1), [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            words[at:at] = (part * 9)[: rng.randrange(1, 5 * len(part) + 1)]
        texts.append(words)
    flat = [ord(w) for t in texts for w in t]
    for least, powers in ((6, 4), (2, 2), (9, 3)):
        got = periodic.runs_of(np.array(flat, np.int64), np.array([len(t) for t in texts]), least, powers)
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, t in enumerate(texts) for r in plain_runs(t, least, powers)]


def test_one_long_text_needs_no_long_search(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 1000)
    rng = np.random.default_rng(3)
    block = rng.integers(0, 50, 700)
    codes = np.concatenate([rng.integers(0, 50, 5000), np.tile(block, 9), [7] * 1000, np.tile([1, 2, 3], 800), rng.integers(0, 50, 5000)])
    got = {tuple(r) for r in periodic.runs_of(codes, np.array([len(codes)])).tolist()}
    assert got == {(0, *r) for r in plain_runs(codes.tolist())} and {r[3] for r in got} >= {1, 3, 700}


def test_extensions_and_minima_by_definition():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 100, 333)
    low = rng.integers(0, 333, 2000)
    high = np.minimum(low + rng.integers(0, 333, 2000), 332)
    assert periodic.Minima(values).of(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]


TEXTS = [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "x"), (4, "x"), (5, "x y " * 3 + "x y"), (6, "no runs at all here today"), (7, "é  é \té  é  é \n é "), (8, "w " * 2000), (9, "A a " * 8)]
TEXTS += [(i, " ".join(random.Random(i).choice("abcd") for _ in range(i % 97))) for i in range(10, 200)]


def test_query_columns_against_plain(spark, tmp_path):
    schema = "doc_id long, text string, runs string, best int, lang string"
    spark.createDataFrame([(i, t, "r", 1, "en") for i, t in TEXTS], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op13_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((plain(*t) for t in TEXTS), key=key)
    assert sum(r.n_runs for r in got) > 20


def test_spans_and_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "say ho ho ho ho ho ho now")], "doc_id int, text string")
    row = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(1, 6, 1)] and row.collapsed == "say ho now"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert periodic.op13_periodic_runs(spark, str(tmp_path)).count() == 0
