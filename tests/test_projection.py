"""Maps of more points than all pairs of them would fit: every vector, compared with the exact method's parts."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from tessel import query_pack
from tessel.errors import ProjectionError
from tessel.operators import neighbours, projection


def test_tsne_maps_more_than_all_pairs_would_fit(spark, tmp_path):
    rng = np.random.default_rng(7)
    n = 5200
    x = rng.normal(size=(n, 6)) + 15 * np.eye(6)[np.arange(n) % 4]
    x[100:140] = x[100]  # copies
    rows = [(3 * i - 50, v.tolist()) for i, v in enumerate(x)] + [(10**6, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = query_pack.queries()["tsne"](spark, str(tmp_path))
    assert got.dtypes == [("vec_id", "bigint"), ("x", "double"), ("y", "double")]
    y = {r.vec_id: (r.x, r.y) for r in got.collect()}
    assert set(y) == {3 * i - 50 for i in range(n)} and got.count() == n
    y = np.array([y[3 * i - 50] for i in range(n)])
    assert np.isfinite(y).all()
    kind = np.arange(n) % 4
    kind[100:140] = 0
    near = np.array([np.argsort(((y - y[i]) ** 2).sum(axis=1))[1:11] for i in range(0, n, 40)])
    assert (kind[near] == kind[0:n:40, None]).mean() > 0.98


@pytest.mark.parametrize("scale", [1e-4, 0.1, 1, 10])
def test_grid_repels_like_all_pairs(scale):
    y = np.random.default_rng(2).normal(size=(1500, 2)) * scale * [1, 0.2]
    d = y[:, None] - y[None]
    q = 1 / (1 + (d * d).sum(axis=2))
    np.fill_diagonal(q, 0)
    with ThreadPoolExecutor(2) as pool:
        force, total = projection.Grid(pool)(y)
    exact = (d * (q * q)[:, :, None]).sum(axis=1)
    assert np.linalg.norm(force - exact) < 0.02 * np.linalg.norm(exact) and abs(total / q.sum() - 1) < 0.005


def test_links_are_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "PART_BYTES", 50 * 5 * 8 * 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    x[30:50] = x[30]
    names = [f"k{i:03d}" for i in range(400)]
    rows = spark.createDataFrame([(names[i], x[i].tolist()) for i in rng.permutation(400)], "k string, v array<double>").repartition(3)
    links = neighbours.graph(rows, 400, 31, 10.0, "k", "v")
    assert links.keys.to_pylist() == names
    near, chance = links.rows(0, 400)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert all(i not in set(near[i]) and len(set(near[i])) == 31 for i in range(400))
    assert np.allclose(np.take_along_axis(d, near.astype(np.int64), 1), np.sort(d, axis=1)[:, :31])
    entropy = -(chance * np.log(np.maximum(chance, 1e-30))).sum(axis=1)
    others = [i for i in range(400) if not 30 <= near[i, 0] < 50]  # where the 20 copies come first, they alone spread wider at any bandwidth
    assert len(others) > 300
    assert np.allclose(chance.sum(axis=1), 1, atol=1e-5) and np.allclose(np.exp(entropy[others]), 10, rtol=1e-3)
    y = rng.normal(size=(400, 2))
    p = np.zeros((400, 400))
    np.put_along_axis(p, near.astype(np.int64), chance.astype(np.float64), 1)
    p, e = (p + p.T) / 800, y[:, None] - y[None]
    with ThreadPoolExecutor(2) as pool:
        got = projection.attraction(y, links, pool)
    assert np.allclose(got, ((p / (1 + (e * e).sum(axis=2)))[:, :, None] * e).sum(axis=1), rtol=1e-3, atol=1e-7)


def test_odd_vectors_are_refused(spark):
    for odd in ([1.0, None], [1.0, float("nan")], [1.0]):
        rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)] + [(9, odd)], "k long, v array<double>")
        with pytest.raises(ProjectionError):
            neighbours.graph(rows, 10, 4, 2.0, "k", "v")
