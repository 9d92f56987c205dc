"""Exact nearest-neighbour search, filtered, single or in batches."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import InvalidRecord, UnsupportedMetric
from ..functions import vectors as V

#: A query set of more bytes is searched in several passes.
MAX_QUERY_BYTES = 64 << 20


def knn(rows: DataFrame, query: Sequence[float] | Column, k: int, metric: str = "l2", key: str = "record_id", vector: str = "vector", where: Column | None = None, within: Column | None = None) -> DataFrame:
    """The k nearest rows with their distance and rank, ties by key.

    The filter sits below the top-k, so the answer is exact however selective it is. Each task keeps k rows (a
    TakeOrderedAndProject), so nothing is shuffled but tasks * k rows. within: a bound that the distance has to meet.
    """
    if k < 1:
        raise InvalidRecord("k has to be at least 1")
    if where is not None:
        rows = rows.where(where)
    found = rows.where(F.col(vector).isNotNull()).withColumn("distance", V.measure(metric, F.col(vector), query))
    if within is not None:
        found = found.where(within)
    order = [V.nearest_first(metric), F.col(key)]
    found = found.orderBy(*order).limit(k)
    # At most k rows reach the window.
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hydrate(found: DataFrame, records: DataFrame, key: str = "record_id") -> DataFrame:
    """Full records for k results: they're few, so the records are scanned but not shuffled. Ids without a record drop out."""
    return records.join(F.broadcast(found), key)


def allowed(rows: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """Restriction to an explicit set of ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Smaller is nearer for all metrics; one row for each query."""
    if metric == "l2":
        return np.stack([((x - v) ** 2).sum(axis=1) for v in q]) if len(q) else np.zeros((0, len(x)))
    s = q @ x.T
    if metric == "cosine":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        s = np.divide(s, size, out=np.zeros_like(s), where=size > 0)
    return -s


def knn_batch(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", key: str = "record_id", vector: str = "vector", query_key: str = "query_id", query_vector: str = "vector", part_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """(query_key, rank, key, distance): the k nearest rows of each query.

    A stated query set goes to all tasks, in parts of at most part_bytes (one pass over the rows for each part). A task
    keeps k rows for each query over all its batches; only these are shuffled, by query, and merged by a window.
    """
    if metric not in V.METRICS:
        raise UnsupportedMetric(metric)
    if k < 1:
        raise InvalidRecord("k has to be at least 1")
    spark = rows.sparkSession
    asked = queries.where(F.col(query_vector).isNotNull() & F.col(query_key).isNotNull()).select(F.col(query_key).alias("q"), V.doubles(F.col(query_vector)).alias("v"))
    size = asked.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), V.doubles(F.col(vector)).alias("v"))
    q_type, k_type = asked.schema["q"].dataType, rows.schema["k"].dataType
    q_arrow, k_arrow = to_arrow_type(q_type), to_arrow_type(k_type)

    def one_pass(part: int) -> DataFrame:
        own = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)
        held = own.collect()
        names, matrix = [r.q for r in held], np.array([r.v for r in held], dtype=np.float64).reshape(len(held), -1)
        shared = spark.sparkContext.broadcast((names, matrix))

        def best(batches):
            names, q = shared.value
            top: list[list[tuple]] = [[] for _ in names]
            for b in batches:
                if not b.num_rows or not names:
                    continue
                keys = b.column("k").to_pylist()
                x = np.asarray(b.column("v").flatten()).reshape(len(keys), -1)
                for lo in range(0, len(names), 64):
                    for i, s in enumerate(_scores(x, q[lo : lo + 64], metric), lo):
                        worst = top[i][-1][0] if len(top[i]) == k else np.inf
                        near = np.flatnonzero(s <= worst)
                        if len(near) > k:  # ties with the k-th stay in
                            near = near[s[near] <= np.partition(s[near], k - 1)[k - 1]]
                        top[i] = sorted(top[i] + [(float(s[j]), keys[j]) for j in near.tolist()])[:k]
            sign = 1.0 if metric == "l2" else -1.0
            flat = [(names[i], key, sign * d) for i, t in enumerate(top) for d, key in t]
            if flat:
                a, b, c = zip(*flat, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, q_arrow), pa.array(b, k_arrow), pa.array(c, pa.float64())], ["q", "k", "distance"])

        return rows.mapInArrow(best, f"q {q_type.simpleString()}, k {k_type.simpleString()}, distance double")

    found = one_pass(0)
    for part in range(1, parts):
        found = found.unionByName(one_pass(part))
    order = Window.partitionBy("q").orderBy(V.nearest_first(metric), "k")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias(query_key), "rank", F.col("k").alias(key), "distance")


def merge_shards(shards: Sequence[DataFrame], k: int, metric: str = "l2", key: str = "record_id") -> DataFrame:
    """The k nearest of several shards' results: each shard answers k rows, the merge sees no more."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.drop("rank").orderBy(V.nearest_first(metric), key).limit(k)


def approximate(rows: DataFrame, query: Sequence[float], k: int, key: str = "record_id", vector: str = "vector", bucket: float = 2.0, tables: int = 4, seed: int = 7) -> DataFrame:
    """Approximate l2 search by random projections; measure its recall against knn() before relying on it."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    data = rows.withColumn("features", array_to_vector(V.doubles(F.col(vector))))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(data)
    near = model.approxNearestNeighbors(data, Vectors.dense([float(x) for x in query]), k, distCol="euclidean")
    return near.select(key, (F.col("euclidean") * F.col("euclidean")).alias("distance"))
