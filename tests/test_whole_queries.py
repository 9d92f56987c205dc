"""Registered queries take all rows of their tables, compared with brute force on small tables."""

import datetime as dt
import json
import os

import numpy as np
import pytest

from tessel import query_pack
from tessel.errors import ProjectionError
from tessel.operators import projection, search

DATA = "/root/testdata/sf0.001"


def test_conflicts_of_late_events(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    kinds = ["view", "purchase", "click", "error"]
    rows = [(2990 + i, i * i % 3, kinds[i * 7 % 5 % 4], start + dt.timedelta(minutes=i * 13 % 101 * 2)) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    hour = dt.timedelta(hours=1)
    for name, reads in (("conflicts_ww", False), ("conflicts_rw", True)):
        pairs = {}
        for v, u, a, t in rows:
            for w, x, b, s in rows:
                if u == x and v != w and (a == "view") == reads and b != "view" and t < s + hour < t + hour:
                    pairs.setdefault((v, u), []).append((s, w))
        assert any(v >= 3000 and max(p)[1] >= 3000 for (v, _), p in pairs.items())
        got = query_pack.queries()[name](spark, str(tmp_path)).collect()
        assert {(r.version, r.record_id): (r.n_others, r.other) for r in got} == {k: (len(p), max(p)[1]) for k, p in pairs.items()} and len(got) == len(pairs)


def test_tsne_maps_all_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(90 + i, rng.normal(size=4).tolist()) for i in range(40)], "vec_id long, embedding array<float>")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r.vec_id for r in query_pack.queries()["tsne"](spark, str(tmp_path)).collect()} == set(range(90, 130))
    spark.range(projection.MAX_POINTS + 1).selectExpr("id as vec_id", "array(1f, 2f) as embedding").write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    with pytest.raises(ProjectionError):
        query_pack.queries()["tsne"](spark, str(tmp_path))


def test_field_paths_of_any_depth(spark, tmp_path):
    deep = {"leaf": 1}
    for i in range(10):
        deep = {f"k{i}": deep}
    spark.createDataFrame([(1, json.dumps(deep)), (2, '{"a": 2}')], "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.path, r.value, r.event_id) for r in query_pack.queries()["field_paths"](spark, str(tmp_path)).collect()}
    names = [f"k{i}" for i in reversed(range(10))] + ["leaf"]
    assert {p for p, _, i in got if i == 1} == {".".join(names[: n + 1]) for n in range(11)}
    assert (".".join(names), "1", 1) in got and ("a", "2", 2) in got and len(got) == 12


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_approximate_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").cache()
    for q in rows.where("vec_id % 100 = 0").collect():
        exact, near = (set(r.vec_id for r in f(rows, list(q.embedding), 10, key="vec_id", vector="embedding").collect()) for f in (search.knn, search.approximate))
        assert len(exact & near) >= 9, q.vec_id
