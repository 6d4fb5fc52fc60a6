"""Density clusters against all pairs, and cells of very many rows."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.operators import neighbours


def plain_clusters(x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(x)).min(1), len(x))
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None], label[None], len(x)).min(1)
    return [None if v == len(x) else int(v) for v in np.where(core, label, border)]


@pytest.mark.parametrize("dims, spread", [(1, 0.2), (2, 0.6), (3, 0.8)])
def test_clusters_equal_all_pairs(spark, monkeypatch, dims, spread):
    """Clumps, chains, copies, scattered rows and a grid whose steps are eps itself; cells compared at once and halved first."""
    rng = np.random.default_rng(dims)
    clumps = [rng.standard_normal(dims) * spread + rng.uniform(-3, 3, dims) for _ in range(260)]
    tight = [np.full(dims, 0.1) + rng.random(dims) * 0.02 for _ in range(60)] + [np.full(dims, 0.13) + rng.random(dims) * 0.02 for _ in range(60)]
    copies = [np.full(dims, 5.0)] * 6 + [np.full(dims, 5.25)] * 2
    grid = [np.full(dims, 8.0) + 0.25 * k * np.eye(dims)[0] for k in range(6)]
    x = np.array(clumps + tight + copies + grid)
    frame = spark.createDataFrame([(i, *map(float, v), "z") for i, v in enumerate(x)] + [(9000, *[None] * dims, "z"), (9001, *[float("nan")] * dims, "z")], "key long, " + ", ".join(f"c{k} double" for k in range(dims)) + ", id string")
    want = plain_clusters(x, 0.25, 4) + [None, None]
    for compared in (4096, 3):
        monkeypatch.setattr(neighbours, "COMPARED", compared)
        got = {r["key"]: r["cluster"] for r in neighbours.dbscan(frame, "key", [f"c{k}" for k in range(dims)], 0.25, 4).collect()}
        assert [got[i] for i in [*range(len(x)), 9000, 9001]] == want
    assert len(set(want)) >= 3 and None in want
    none = frame.limit(0)
    assert neighbours.dbscan(none, "key", ["c0"], 0.25, 4).count() == 0


def test_a_cell_of_a_million_rows_makes_no_pairs(spark):
    """All pairs of the cell would be 10^12; its two halves lie in neighbouring cells and are linked."""
    rows = spark.range(1_000_000).select("id", (F.rand(3) * 0.02 + 0.995).alias("x"), (F.rand(4) * 0.01).alias("y")).unionByName(spark.createDataFrame([(2_000_000, 3.0, 3.0), (2_000_001, 1.04, 0.005)], "id long, x double, y double"))
    began = time.time()
    got = {r["cluster"]: r["n"] for r in neighbours.dbscan(rows, "id", ["x", "y"], 0.05, 10).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 1_000_001, None: 1} and time.time() - began < 200


@pytest.mark.parametrize("missing", [False, True])
def test_pruned_search_equals_all_pairs_and_compares_few(spark, monkeypatch, missing):
    """Clumped vectors with copies and ties, in small blocks; with missing components all pairs are compared."""
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    monkeypatch.setattr(neighbours, "CELLS", 5000)
    rng = np.random.default_rng(6)
    centres = rng.uniform(-50, 50, (30, 6))
    x = np.round(np.concatenate([centres[rng.integers(30, size=1500)] + rng.standard_normal((1500, 6)), np.tile(centres[0], (20, 1)), rng.uniform(-60, 60, (30, 6))]), 1)
    if missing:
        x[5, 2] = np.nan
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(5)
    ask = [*range(0, 1550, 7), 5]
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in ask] + [(9000, [500.0] * 6)], "q long, qv array<double>")
    found, told = neighbours.nearest_pruned(rows, queries, 4, pivots=40)
    got = {}
    for r in found.collect():
        got.setdefault(r["q"], []).append((r["d"], r["id"]))
    for q in [*ask, 9000]:
        v = x[q] if q < 9000 else np.full(6, 500.0)
        both = ~np.isnan(x - v)
        d = np.sqrt(np.where(both, (x - v) ** 2, 0).sum(1) * 6 / both.sum(1))
        want = sorted((float(d[i]), i) for i in range(len(x)) if i != q)[:4]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want] and np.allclose([g for g, _ in sorted(got[q])], [w for w, _ in want])
    told = told.first()
    assert told["all"] == 1550 * (len(ask) + 1) and (told["compared"] == told["all"] if missing else told["compared"] < 0.3 * told["all"])
    assert neighbours.nearest_pruned(rows.limit(0), queries, 3)[0].count() == 0 and neighbours.nearest_pruned(rows, queries.limit(0), 3)[0].count() == 0
    few, _ = neighbours.nearest_pruned(rows.where("id < 3"), queries.where("q = 0"), 9)
    assert sorted(r["id"] for r in few.collect()) == [1, 2]


@pytest.mark.parametrize("kind", ["plain", "copies", "grid", "far", "few", "missing"])
def test_best_of_a_block_equals_all_differences(kind, monkeypatch):
    """candidates by a product of matrices, then exact distances; ties by id, itself left out, cancellation far from 0."""
    rng = np.random.default_rng(4)
    x = {
        "plain": rng.standard_normal((300, 9)), "copies": np.tile(rng.standard_normal((30, 9)), (10, 1)), "grid": rng.integers(0, 3, (300, 4)).astype(float),
        "far": 1e8 + rng.standard_normal((300, 6)), "few": rng.standard_normal((3, 4)), "missing": np.where(rng.random((300, 5)) < 0.2, np.nan, rng.standard_normal((300, 5))),
    }[kind]
    ids = rng.permutation(len(x))
    group = pd.DataFrame({"key": np.r_[ids, ids[:20]], "v": [*x, *x[:20]], "asks": [0] * len(x) + [1] * len(x[:20])})
    monkeypatch.setattr(neighbours, "CELLS", 700)
    got = {q: g.sort_values(["d", "id"])["id"].tolist() for q, g in neighbours._best(group, 5).groupby("q")}
    gap = x[:20, None] - x[None]
    seen = (~np.isnan(gap)).sum(2)
    d = np.sqrt(np.nansum(gap * gap, 2) * gap.shape[2] / np.maximum(seen, 1))
    d[(seen == 0) | (ids[:20, None] == ids[None])] = np.inf
    for i, q in enumerate(ids[:20]):
        want = [int(ids[j]) for j in np.lexsort((ids, d[i]))[:5] if np.isfinite(d[i, j])]
        assert got[q] == want


def test_complete_blocks_hold_no_differences_of_all_pairs(monkeypatch):
    """of 400 rows and 100 queries only pairs that may be among the best are compared number by number."""
    rng = np.random.default_rng(6)
    compared, plain = [], np.sqrt
    monkeypatch.setattr(neighbours.np, "sqrt", lambda v: compared.append(np.size(v)) or plain(v))
    x = rng.standard_normal((500, 16))
    neighbours._best(pd.DataFrame({"key": np.arange(500), "v": list(x), "asks": [0] * 400 + [1] * 100}), 5)
    assert 500 <= sum(compared) < 700
