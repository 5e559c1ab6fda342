"""Links with cosines near the threshold, in large tables and in crowds just below it."""

import numpy as np
import pytest

from siltwork.llm import vectors


def _partner(rng, v, cosine):
    """For each unit vector another with this cosine to it."""
    r = rng.standard_normal(v.shape)
    r -= (r * v).sum(axis=1)[:, None] * v
    return cosine * v + np.sqrt(1 - cosine**2) * r / np.linalg.norm(r, axis=1)[:, None]


@pytest.mark.parametrize("reach", [256, 2048])
def test_crowds_below_the_threshold_hide_no_links(spark, reach):
    rng = np.random.default_rng(5)
    heart = np.tile(np.eye(64)[0], (1500, 1))
    crowd = _partner(rng, heart, 0.93)  # cosines with one another near 0.865
    v = np.concatenate([crowd, _partner(rng, crowd[:100], 0.901)])
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), reach=reach).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert want.sum() >= 200
    assert [got[i] for i in range(len(v))] == want.tolist()


def test_passes_follow_the_number_of_vectors():
    share = 1 - np.arccos(0.9) / np.pi
    for n in (1_000, 12_000, 64_000, 1_000_000, 4_000_000, 100_000_000):
        depth, passes = vectors.plan(n, 0.9, 2048, 0.999)
        assert n / 2**depth <= 2048
        assert 1 - (1 - share**depth) ** passes >= 0.999


def test_passes_beyond_one_round(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((600, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v = np.concatenate([v, _partner(rng, v[:50], 0.91)])
    assert vectors.plan(len(v), 0.9, 8, 0.999)[1] > 16
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), window=4, reach=8).collect()}
    assert [got[i] for i in range(len(v))] == ((v @ v.T >= 0.9).sum(axis=1) - 1).tolist()
