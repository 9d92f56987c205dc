import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.errors import EmptyVector, InvalidRecord, ProjectionError, UnsupportedMetric
from tessel.functions import vectors
from tessel.operators import projection, search


def points(spark, named):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in named.items()], "record_id string, vector array<float>")


def ids(df):
    return [r.record_id for r in df.orderBy("rank").collect()]


def test_basics(spark):
    rows = points(spark, {"rec1": [1, 2, 3], "rec2": [4, 5, 6], "rec3": [7, 8, 9], "rec4": [0.5, 1.5, 2.5]})
    assert ids(search.knn(rows, [3.5, 4.5, 5.5], 2))[0] == "rec2"
    assert len(ids(search.knn(rows, [0, 0, 0], 99))) == 4
    assert search.knn(rows, [1, 2, 3], 1).first().distance == 0
    with pytest.raises(InvalidRecord):
        search.knn(rows, [1, 2, 3], 0)
    with pytest.raises(UnsupportedMetric):
        search.knn(rows, [1, 2, 3], 1, "hamming")
    with pytest.raises(EmptyVector):
        search.knn(rows, [], 1)


def test_grid_and_ties(spark):
    grid = points(spark, {f"vec_{x}_{y}": [x, y, 0] for x in range(5) for y in range(5)})
    assert ids(search.knn(grid, [2.1, 2.1, 0], 4))[0] == "vec_2_2"
    same = points(spark, {f"v{i:03d}": [1, 1] for i in range(50)})
    assert ids(search.knn(same, [0, 0], 5)) == [f"v{i:03d}" for i in range(5)]


def test_metrics(spark):
    rows = points(spark, {"vec_1": [1, 0, 0], "vec_2": [0, 1, 0], "vec_3": [0, 0, 1], "vec_4": [2, 0, 0], "vec_5": [1, 1, 1], "zero": [0, 0, 0]})
    assert ids(search.knn(rows, [1, 0, 0], 1, "ip")) == ["vec_4"]
    two = search.knn(rows, [1, 0, 0], 2, "cosine").collect()
    assert {r.record_id for r in two} == {"vec_1", "vec_4"} and two[0].distance == two[1].distance == 1
    assert rows.select(vectors.measure("l2", F.col("vector"), [1, 1, 0]).alias("d")).where("record_id = 'vec_4'").first().d == 2


def test_filter_comes_before_top_k(spark):
    rows = points(spark, {f"v{i}": [i, i + 1, i + 2] for i in range(300)})
    assert ids(search.knn(rows, [5, 6, 7], 3, where=F.col("record_id").isin("v0", "v299"))) == ["v0", "v299"]
    some = spark.createDataFrame([("v7",), ("v7",), ("none",)], "record_id string")
    assert ids(search.knn(search.allowed(rows, some), [5, 6, 7], 3)) == ["v7"]


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_batch_is_single(spark, metric):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"r{i}", rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(120)] + [("null", None)], "record_id string, vector array<float>")
    queries = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(7)], "query_id int, vector array<float>")
    for part_bytes in (1 << 20, 100):
        batch = search.knn_batch(rows.repartition(5), queries, 6, metric, part_bytes=part_bytes).collect()
        assert len(batch) == 42
        for q in queries.collect():
            single = search.knn(rows, q.vector, 6, metric).orderBy("rank").collect()
            mine = sorted((r for r in batch if r.query_id == q.query_id), key=lambda r: r["rank"])
            assert [r.record_id for r in mine] == [r.record_id for r in single]
            assert np.allclose([r.distance for r in mine], [r.distance for r in single])


def test_shards(spark):
    rows = points(spark, {f"v{i}": [i, 0] for i in range(20)})
    shards = [search.knn(rows.where(F.substring("record_id", -1, 1).cast("int") % 2 == p), [0, 0], 4) for p in (0, 1)]
    assert [r.record_id for r in search.merge_shards(shards, 4).collect()] == ["v0", "v1", "v2", "v3"]


def test_shapes(spark):
    one = spark.createDataFrame([([3.0, 4.0], "0.1,0.2", "[0.5, x]")], "v array<float>, a string, b string")
    r = one.select(vectors.normalized(F.col("v")).alias("n"), vectors.fitted(F.col("v"), 4, 9).alias("p"), vectors.fitted(F.col("v"), 1).alias("c"), vectors.parsed(F.col("a")).alias("a"), vectors.parsed(F.col("b")).alias("b")).first()
    assert np.allclose(r.n, [0.6, 0.8]) and r.p == [3, 4, 9, 9] and r.c == [3] and np.allclose(r.a, [0.1, 0.2]) and r.b == [0.5, None]


def test_approximate_recall(spark):
    rng = np.random.default_rng(3)
    rows = points(spark, {f"v{i:03d}": rng.normal(size=8) for i in range(300)})
    q = rng.normal(size=8).tolist()
    exact = set(ids(search.knn(rows, q, 10)))
    near = {r.record_id for r in search.approximate(rows, q, 10).collect()}
    assert len(exact & near) >= 7


def test_projection(spark):
    rng = np.random.default_rng(0)
    rows = points(spark, {f"{c}{i}": rng.normal(size=10) + 12 * c for c in (0, 1) for i in range(15)})
    found = projection.project(rows, perplexity=5).collect()
    xy = {r.record_id: np.array([r.x, r.y]) for r in found}
    means = [np.mean([v for k, v in xy.items() if k[0] == c], axis=0) for c in "01"]
    spread = max(np.linalg.norm(v - means[int(k[0])]) for k, v in xy.items())
    assert len(xy) == 30 and np.linalg.norm(means[0] - means[1]) > spread
    assert projection.project(rows, perplexity=5).collect() == found
    with pytest.raises(ProjectionError):
        projection.project(rows, max_points=5)


def test_plan_keeps_k_rows_per_task(spark, tmp_path):
    points(spark, {f"v{i}": [i, 0] for i in range(20)}).withColumn("wide", F.lit("x")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).select("record_id", "vector")
    plan = search.knn(rows, [0, 0], 4)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "wide" not in plan.split("ReadSchema:")[1]
