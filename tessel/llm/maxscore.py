"""Exact top-k inner-product search by MaxScore.

A vector is a document whose terms are its dimensions; a term's weight is floor(1024 * x). A query's term contributes
q * w, which may be negative, so a shard keeps each term's least and largest weight: contributions are counted from the
least possible one, and the spread between the two is the term's score bound.

For each query a shard orders the terms by bound. Terms whose bounds together stay below the k-th best score known are
non-essential: a vector can't win by them alone. The essential terms' postings are traversed, chunk by chunk of the shard;
for vectors whose partial score plus the bounds that are left can reach the k-th best score, the non-essential terms are
probed, the largest bound first, as long as that holds. Each chunk may raise the k-th best score and so move the split.
The first score to beat comes from one shard, which all queries ask beforehand; where all terms are non-essential, a shard
is skipped.

Queries and vectors are packed, `block` rows to a value. Each query block meets each shard once, on the shard's number:
a stated query set against all rows, in blocks. A shard returns k rows at most for each query, which a window then merges.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither do rows of a null id;
a product over vectors of different length counts the dimensions both have; ties go to the smaller id; of rows that share
an id, each is a candidate of its own, and each query id is asked once, with its least vector; a query's own id is no
candidate; fewer candidates than k give fewer rows; columns beyond id and vector aren't read; empty tables give no rows.
Scores must fit 62 bits, which holds for |x| < 2**20 and 2**16 dimensions.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shard_top(ids: np.ndarray, weights: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, k: int, chunk: int = 256, trace: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, id, score) of each query's k best vectors of a shard, without such as can't be among the k best of all.

    weights: one row for each dimension (its postings). known: for each query a score that k vectors have, or nan. chunk: vectors
    of the first step; each step takes twice as many as the last. trace: gets (query's number, step, essential terms, candidates).
    """
    least, most = weights.min(axis=1), weights.max(axis=1)
    out = [], [], []
    for number, (own, q, threshold) in enumerate(zip(query_ids.tolist(), queries, known.tolist(), strict=True)):
        floor = np.minimum(q * least, q * most)
        bound = np.maximum(q * least, q * most) - floor
        terms = np.argsort(bound, kind="stable")
        total = np.concatenate([[0], np.cumsum(bound[terms])])  # of the smallest bounds
        base, split = floor.sum(), 0
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        lo, size, step = 0, chunk, 0
        while lo < len(ids):
            hi = min(len(ids), lo + size)
            if not np.isnan(threshold):
                split = int(np.searchsorted(total[1:], threshold - base, side="left"))  # total[split] < threshold - base
            essential = terms[split:]
            if len(essential) or np.isnan(threshold) or total[split] >= threshold - base:
                alive = np.flatnonzero(ids[lo:hi] != own)
                score = (q[essential] @ weights[essential, lo:hi] - floor[essential].sum())[alive]
                left = split
                while True:
                    if not np.isnan(threshold):  # a vector that can only tie may still win by its id
                        may = score + total[left] >= threshold - base
                        alive, score = alive[may], score[may]
                    if trace is not None and left == split:
                        trace.append((number, step, len(essential), len(alive)))
                    if not left or not len(alive):
                        break
                    probed = terms[max(0, left - 4) : left]
                    score = score + q[probed] @ weights[np.ix_(probed, alive + lo)] - floor[probed].sum()
                    left -= len(probed)
                best_id, best = np.concatenate([best_id, ids[lo:hi][alive]]), np.concatenate([best, score + base])
                if len(best) > k:
                    top = np.lexsort((best_id, -best))[:k]
                    best_id, best = best_id[top], best[top]
                if len(best) == k:
                    threshold = np.fmax(threshold, best.min())
            lo, size, step = hi, 2 * size, step + 1
        out[0].append(np.full(len(best), number))
        out[1].append(best_id)
        out[2].append(best)
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in out)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, w): weights of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * 1024).cast("long")).alias("w"))


def packed(rows: DataFrame, part: str) -> DataFrame:
    """One row for each value of part: ids, weights and known scores as binary."""

    def pack(t: pa.Table) -> pa.Table:
        ids = np.asarray(t.column("id").combine_chunks()).astype(np.int64)
        lists = t.column("w").combine_chunks()
        size = np.diff(np.asarray(lists.offsets))
        w = np.zeros((len(ids), int(size.max(initial=0))), dtype=np.int64)
        w[np.arange(w.shape[1])[None, :] < size[:, None]] = np.asarray(lists.flatten())
        small = np.int32 if not w.size or np.abs(w).max() < 2**31 else np.int64
        known = np.asarray(t.column("known").combine_chunks().cast(pa.float64()).fill_null(float("nan")))
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ids, w.astype(small), known)]
        return pa.table([t.column(part).slice(0, 1), *blobs, pa.array([small is np.int64])], names=[part, "ids", "weights", "known", "wide"])

    return rows.groupBy(part).applyInArrow(pack, f"{part} int, ids binary, weights binary, known binary, wide boolean")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank, id, score: the k vectors of the largest inner product for each query. queries: rows like those of vectors."""
    data = usable(vectors, id_col, vector_col).withColumn("known", F.lit(None).cast("double"))
    asked = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("w").alias("w"))
    n_shards = max(1, -(-data.count() // block))
    n_blocks = max(1, -(-asked.count() // query_block))
    shards = packed(data.withColumn("shard", F.pmod(F.xxhash64("id", "w"), F.lit(n_shards)).cast("int")), "shard")

    def search(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, query_ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["query_known"], np.float64)
                w = np.frombuffer(r["weights"], np.int64 if r["wide"] else np.int32).reshape(len(ids), -1).T.astype(np.int64)
                q = np.frombuffer(r["query_weights"], np.int64 if r["query_wide"] else np.int32).reshape(len(query_ids), -1).astype(np.int64)
                both = min(len(w), q.shape[1])
                # Sums below 2**53 are exact in float64, whose products are much faster.
                if both and float(np.abs(w[:both]).max(initial=0)) * float(np.abs(q[:, :both]).max(initial=0)) * both * 4 < 2**53:
                    w, q = w.astype(np.float64), q.astype(np.float64)
                else:
                    known = np.full(len(known), np.nan)  # beyond 2**53 a known score may be rounded
                if both:
                    number, found, score = shard_top(ids, np.ascontiguousarray(w[:both]), query_ids, q[:, :both], known, k)
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[number]), pa.array(found.astype(np.int64)), pa.array(score.astype(np.int64))], ["query_id", "id", "score"])

    def found(asked: DataFrame, some: DataFrame, numbers) -> DataFrame:
        blocks = packed(asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")), "part")
        sent = blocks.select(F.explode(numbers).alias("shard"), *(F.col(c).alias(f"query_{c}") for c in ("ids", "weights", "known", "wide")))
        return sent.join(some, "shard").mapInArrow(search, "query_id long, id long, score long")

    nothing = F.lit(None).cast("double")
    if n_shards > 1:
        first = found(asked.withColumn("known", nothing), shards.where("shard = 0"), F.array(F.lit(0)))
        known = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("known"))
        asked = asked.join(known, "id", "left")
    else:
        asked = asked.withColumn("known", nothing)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rows = found(asked, shards, F.sequence(F.lit(0), F.lit(n_shards - 1)))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
