"""Clusters larger than a block of the projection passes."""

import numpy as np
import pytest

from siltwork.llm import vectors


@pytest.mark.parametrize(("reach", "window"), [(16, 4), (32, 8), (4096, 8)])
def test_walks_go_on_through_all_blocks(spark, reach, window):
    rng = np.random.default_rng(3)
    heart = rng.standard_normal(16)
    near = heart + 0.05 * rng.standard_normal((150, 16))
    v = np.concatenate([near, rng.standard_normal((100, 16)), [heart, heart]])
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), passes=4, window=window, reach=reach).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert [got[i].n_links for i in range(len(v))] == want.tolist()
    assert {got[i].component_id for i in [*range(150), 250, 251]} == {0}
    assert all(got[i].component_id == i and got[i].kept for i in range(150, 250))


def test_ids_and_lengths_of_vectors(spark):
    """Huge and tiny values, ids that repeat or are null, clashing columns, an empty table."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((30, 8))
    data = [(i, (x * 10.0 ** (i * 20 - 300)).tolist()) for i, x in enumerate(v)]
    data += [(50, [1e200, 1e200]), (51, [1.0, 1.0]), (52, [5e-324, 5e-324]), (53, [1e308, -1e308])]
    data += [(60, v[0].tolist()), (60, v[1].tolist()), (60, v[1].tolist()), (None, v[2].tolist()), (None, None), (61, []), (62, [float("inf"), 1.0]), (63, [1.0] * 3)]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "vec_id long, embedding array<double>, id int, members int")
    got = sorted(((2**63 if r.vec_id is None else r.vec_id), r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect() if r.vec_id is not None or r.component_id is not None)
    with np.errstate(all="ignore"):
        unit = [None if not x or not np.isfinite(x).all() else np.array(x) / np.abs(x).max() for _, x in data]
    link = lambda x, y: x is not None and y is not None and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9
    near = [{j for j, y in enumerate(unit) if j != i and link(x, y)} for i, x in enumerate(unit)]
    want = []
    for i, (d, _) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [data[j][0] for j in seen if data[j][0] is not None]
        if ids:
            want.append((2**63 if d is None else d, len(near[i]), min(ids), d == min(ids)))
    assert got == sorted(want)
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectors.near_vectors(none).count() == 0
