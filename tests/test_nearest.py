import random

import numpy as np
import pytest

from locusloom.operators import nearest

SCHEMA = "id long, x double, y double"


def brute(cand, targ, k):
    out = []
    for c in cand:
        far = sorted((max(abs(a - b) for a, b in zip(c[1:], t[1:], strict=True)), t[0]) for t in targ)
        out += [(c[0], i + 1, t, d) for i, (d, t) in enumerate(far[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_k_equals_brute_force(spark, monkeypatch, k):
    """Small leaves and blocks; a dense corner, far points, equal vectors, ties."""
    for name, value in (("LEAVES", 16), ("TARGETS", 20), ("POINTS", 15)):
        monkeypatch.setattr(nearest, name, value)
    rng = random.Random(k)
    spot = lambda: (rng.choice([0.0, 1.0, round(rng.gauss(0, 1), 2)]), round(rng.gauss(0, 1) ** 3, 2))
    targ = [(i, *spot()) for i in range(300)] + [(300 + i, 0.5, 0.5) for i in range(40)]
    cand = [(i, *spot()) for i in range(200)] + [(200, 1e6, -1e6), (201, 0.5, 0.5), (202, 0.5, 0.5)]
    odd = [(900, None, 1.0), (901, float("nan"), 1.0)]
    got = nearest.nearest_k(spark.createDataFrame(cand + odd, SCHEMA), spark.createDataFrame(targ + odd, SCHEMA), ["x", "y"], k)
    assert sorted(tuple(r) for r in got.collect()) == brute(cand, targ, k)


def test_nearest_k_of_few_or_no_targets(spark):
    cand = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], SCHEMA)
    two = spark.createDataFrame([(7, 1.0, 1.0), (8, 9.0, 9.0)], SCHEMA)
    assert len(nearest.nearest_k(cand, two, ["x", "y"], 5).collect()) == 4
    assert nearest.nearest_k(cand, two.limit(0), ["x", "y"], 5).collect() == []
    assert nearest.nearest_k(cand.limit(0), two, ["x", "y"], 5).collect() == []


@pytest.mark.parametrize("k", [1, 20])
def test_cells_of_points_are_looked_up_in_the_tree(monkeypatch, k):
    """The leaves within a bound, and the first ones, are those of all boxes; points far from few boxes never meet them all."""
    rng = np.random.default_rng(k)
    targets, points = rng.normal(size=(4_000, 3)), rng.normal(size=(200, 3)) * 1.5
    tree = nearest.grow_tree(targets[::2])
    leaf = nearest.leaf_of(tree, targets)
    cells, held = np.unique(leaf, return_counts=True)
    low, high = (np.array([f(targets[leaf == c], axis=0) for c in cells]) for f in (np.min, np.max))
    node_low, node_high, node_held = nearest.node_boxes(tree, cells, held, low, high)
    assert node_held[0] == 4_000 and (node_low[0] == targets.min(axis=0)).all()
    bound = np.where(np.arange(200) % 10 == 0, np.inf, 0.2)
    far = nearest.box_distances(points, low, high)
    want = {(i, int(cells[j])) for i, j in zip(*np.nonzero(far <= bound[:, None]), strict=True)}
    asked = []
    monkeypatch.setattr(nearest, "box_distances", lambda x, lo, hi: asked.append(len(x)) or np.maximum(lo[None] - x[:, None], x[:, None] - hi[None]).max(axis=2).clip(0))
    row, cell = nearest.cells_within(tree, node_low, node_high, node_held, points, bound)
    assert len(row) == len(want) and set(zip(row.tolist(), cell.tolist(), strict=True)) == want
    row, cell = nearest.nearest_cells(tree, node_held, cells, held, low, high, points, k)
    assert (np.bincount(row, weights=node_held[cell], minlength=200) >= k).all()
    assert sum(asked) < 200


def test_features_are_spelled_once_before_they_are_filtered(spark, monkeypatch):
    """What the search is given is stored: no filter or count of it spells the texts again."""
    from locusloom.plans.queries import QUERIES

    given = []
    none = spark.createDataFrame([], "id long, rank long, target_id long, dist double")
    monkeypatch.setattr(nearest, "nearest_k", lambda candidates, targets, *rest: given.extend([candidates, targets]) or none)
    QUERIES["chebyshev_nearest"](spark, "/root/testdata/sf0.001")
    assert len(given) == 2
    for df in given:
        assert "translate" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
