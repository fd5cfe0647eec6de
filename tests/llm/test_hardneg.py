"""Hard negatives against brute force over all pairs."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, key string"


def prepared(rows):
    out = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    common = Counter(len(v) for _, _, v in out)
    size = min(common, key=lambda n: (-common[n], n), default=0)
    return [r for r in out if len(r[2]) == size]


def plain(rows):
    rows = prepared(rows)
    out = []
    for anchor in dict.fromkeys(r for r in rows if r[0] % 50 == 0):
        others = list(rows)
        others.remove(anchor)  # its own row, once
        scored = sorted(((sum(x * y for x, y in zip(anchor[2], v)), i, label) for i, label, v in others), key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scored if s[2] == anchor[1]][:5]:
            fit = [s for s in scored if s[2] != anchor[1] and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(anchor[0], i, k + 1, s[1], p, s[0]) for k, s in enumerate(fit)]
    return sorted(out)


def generated(n, seed, spread, dim=6, labels=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, dim))
    rows = []
    for i in range(n):
        v = middles[rng.integers(9)] + rng.normal(size=dim) * spread
        rows.append((i, [float(x) for x in np.round(v, 2).astype(np.float32)], int(rng.integers(labels))))
    return rows


@pytest.fixture
def small_nodes(monkeypatch):
    for name, value in (("CELL_ROWS", 40), ("CHUNK", 24), ("LEAF", 4), ("BLOCK", 8), ("ANCHOR_LEAF", 3)):
        monkeypatch.setattr(hardneg, name, value)


def asked(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, label, 1, "k") for i, v, label in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, hardneg.op12_hard_negatives(spark, str(tmp_path)).collect()))


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_brute_force_in_a_deep_tree(spark, tmp_path, small_nodes, spread):
    rows = generated(900, 3, spread)
    rows += [(1000 + i, rows[50][1], i % 2) for i in range(60)]  # many copies of an anchor, ids divisible by 50 among them
    rows += [(50, rows[50][1], rows[50][2]), (50, rows[50][1], rows[50][2]), (100, rows[7][1], 3), (100, rows[8][1], rows[100][2])]  # repeated rows and ids
    want = plain(rows)
    assert asked(spark, tmp_path, rows) == want and len(want) > 100


def test_odd_rows_take_no_part_and_sql_agrees(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = generated(300, 5, 0.6, labels=10)
    rows += [(350, None, 1), (400, [1.0] * 6, None), (450, [1.0, None, *[1.0] * 4], 1), (500, [nan] + [1.0] * 5, 2), (550, [inf] * 6, 2), (600, [0.0] * 6, 3), (601, [0.0] * 6, 3), (602, [0.0] * 6, 4), (650, [-1.0] * 6, 5)]
    got = asked(spark, tmp_path, rows)
    assert got == plain(rows) and {r[0] for r in got} & {0, 50, 100} and any(r[4] == 0 for r in got)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.sql(hardneg.SQL).fetchall()) == got
    assert asked(spark, tmp_path, [*rows, (None, [1.0] * 6, 1), (700, [1.0] * 5, 1), (750, [], 1)]) == got


def test_empty_and_lone_rows(spark, tmp_path):
    assert asked(spark, tmp_path, []) == asked(spark, tmp_path, [(0, None, 1)]) == asked(spark, tmp_path, [(0, [1.0, 2.0], 1)]) == []
    assert asked(spark, tmp_path, [(100, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.75, 0.5], 2)]) == [(100, 2, 1, 3, 65536, 49152)]


def test_leaf_pairs_are_pruned_for_whole_groups(monkeypatch):
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(64, 16)) * 300
    v = np.concatenate([m + rng.normal(size=(128, 16)) * 5 for m in middles]).astype(np.int64)
    groups = hardneg.halves(v.astype(float), 128)
    at, sizes = np.concatenate(groups), np.array([len(g) for g in groups])
    v, labels = v[at], rng.integers(0, 5, len(v))
    centres, radii, masks = hardneg.balls(v.astype(float), labels, sizes)
    node = {"ids": np.arange(len(v)), "labels": labels, "vecs": v, "cuts": np.append(0, np.cumsum(sizes)), "centres": centres, "radii": radii, "masks": masks}
    scored, plainly = [], hardneg.products
    monkeypatch.setattr(hardneg, "products", lambda a, c: scored.append(len(c)) or plainly(a, c))
    own = np.arange(16)
    found = hardneg.leaf_search(v[own], labels[own], np.full((16, 1), hardneg.NONE + 1), np.full((16, 1), hardneg.MOST), node, True, 5)
    assert sum(scored) <= len(v) / 2
    score = np.where(labels[own, None] == labels, v[own] @ v.T, -(2**60))
    want = [(a, 0, int(score[a, i]), int(i)) for a in range(16) for i in np.lexsort((np.arange(len(v)), -score[a]))[:5]]
    assert [tuple(r[:4]) for r in found.tolist()] == want


def test_intervals_hold_all_products():
    rng = np.random.default_rng(2)
    a, c = rng.integers(-300, 300, (40, 8)), rng.integers(-300, 300, (90, 8))
    (ca, ra, _), (cc, rc, _) = (hardneg.balls(x.astype(float), np.zeros(len(x), int), np.full(len(x) // 10, 10)) for x in (a, c))
    least, most = hardneg.intervals(ca, ra, cc, rc)
    score = (a @ c.T).reshape(4, 10, 9, 10)
    assert (score.min(axis=(1, 3)) >= least).all() and (score.max(axis=(1, 3)) <= most).all()


def test_large_components_keep_exact_scores():
    a = np.array([[2**27, 3], [5, -7]])
    assert hardneg.products(a, a).tolist() == [[2**54 + 9, 5 * 2**27 - 21], [5 * 2**27 - 21, 74]]


def test_bins_hold_every_chunk_once():
    from ledgerlens.llm.common import Bins

    for parts in ([1], [3, 1, 1, 7], [1] * 900 + [400] + [2] * 60):
        bins = Bins(np.array(parts))
        at = [int(bins.of(c, p)) for c, n in enumerate(parts) for p in range(n)]
        cells = bins.cells()
        assert at == sorted(at) and set(at) == set(range(bins.n)) and bins.n <= max(48, sum(parts) // 24)
        assert all(c in cells[b] for b, c in zip(at, (c for c, n in enumerate(parts) for _ in range(n))))
