"""The tree over vectors rules out no link, and tiles of any size agree."""

import math

import numpy as np
import pytest

from trialspark.llm import vector_links as V


def brute(x, labels, threshold):
    unit = V.units(x)
    linked = (unit @ unit.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        low = np.where(linked, root[None, :], len(x)).min(axis=1)
        new = np.minimum(root, low)
        if (new == root).all():
            return linked.sum(axis=1), root
        root = new


@pytest.mark.parametrize("part, leaves", [(1 << 13, 256), (100, 8), (64, 1), (150, 4)])
def test_leaves_and_parts_agree_with_all_pairs(spark, part, leaves):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * np.array([4, 3, 2, 2] + [1] * 12)
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * rng.choice([0.05, 0.2, 1.0], (900, 1))).astype(np.float32)
    x[17] = x[3]
    labels = rng.integers(0, 2, 900)
    table = spark.createDataFrame([(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, labels))], "vec_id bigint, embedding array<float>, label int")
    n, root = brute(x.astype(np.float64), labels, 0.98)
    got = sorted(V.near_vectors(table, part=part, leaves=leaves, block=64).collect())
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [(int(a), int(b), i == b) for i, (a, b) in enumerate(zip(n, root))] and n.sum() > 100


def test_far_leaves_hold_no_links_and_many_are_ruled_out():
    rng = np.random.default_rng(6)
    centres = V.units(rng.normal(size=(30, 24)))
    x = V.units(centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 24)) * 0.01)
    tree = V.Tree(x[::3], 16)
    places = tree.places(x)
    leaf = tree.leaf(places)
    assert set(leaf.tolist()) == set(range(16))
    near = dict(V.near_leaves({i: (places[leaf == i].min(axis=0), places[leaf == i].max(axis=0)) for i in range(16)}, 0.98))
    i, j = np.nonzero(x @ x.T >= 0.98)
    assert all(b in near[a] for a, b in {*zip(leaf[i].tolist(), leaf[j].tolist())})
    assert sum(map(len, near.values())) < 200  # of 256


def test_vectors_of_unequal_lengths_and_huge_ones(spark):
    rows = [(0, [1e300] * 3, 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [-0.0, 5.0], 1), (5, [0.0, 5.0], 1), (5, [0.0, 5.0], 1), (None, [0.0, 1.0], 1), (7, [math.inf, 0.0], 1)]
    got = {(r.vec_id, r.n_links, r.component_id) for r in V.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {(0, 0, 0), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 3, 4), (5, 3, 4), (None, 3, 4), (7, 0, 7)}
