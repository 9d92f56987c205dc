"""Similarity join on word n-grams: MinHash banding finds candidates, full n-gram sets decide.

Words are as in folding (A-Z lower-cased; digits, a-z and all non-ASCII characters form words); a document's set holds
its n-grams of `n` words, or its whole word sequence where it has fewer. Two documents link at Jaccard >= threshold.

1. Documents with one word sequence are copies: one of them, of the smallest doc_id, stands for all (a class).
2. Each class has `bands * rows` minima of permuted n-gram hashes. With 28 bands of 6 rows, a pair of similarity 0.8 meets
   in a band with probability 1 - (1 - 0.8**6)**28 = 0.9998 and one of 0.3 with 0.02.
3. Classes are shuffled on their band hashes. Buckets of the same classes count as one, that of the first band. A bucket is
   compared on full n-gram sets, with counts of common n-grams from blocked matrix products. One of over `block` classes
   is cut into slices, and each pair of slices is a task of its own, so no task holds more than 2 * block documents
   however large the bucket is. A pair counts in the first band in which it meets. Tasks return a row for each document
   that has links, never pairs.
4. Connected components of the verified links give the classes' ids.

Defined cases: a document without words links to nothing and is its own class; of rows that share a doc_id, the one of
the smallest word-sequence hash counts and one row comes back; rows of a null doc_id take no part and don't come back;
columns beyond id and text aren't read; a long text's n-grams are held at once, some 100 bytes for each word; an empty
table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, kept, slices
from .textarrays import FOLD_TABLE, U64, flat, mix, prefix_sums, span_hash, word_bounds, word_names

_random = np.random.Generator(np.random.PCG64(7))
FLIPS = _random.integers(0, 1 << 63, 4096, dtype=np.uint64)
FACTORS = _random.integers(0, 1 << 63, 4096, dtype=np.uint64) * U64(2) + U64(1)


def ngrams(column, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, where each row's start, and each row's words and two hashes of its word sequence."""
    data, rows = flat(column)
    data = FOLD_TABLE[data]
    starts, ends, first = word_bounds(data, rows)
    names = word_names(data, starts, ends)
    sums, words = prefix_sums(names), np.diff(first)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    begin = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    end = np.minimum(begin + n, first[1:][row])
    grams = mix(span_hash(sums, begin, end) + (end - begin).astype(np.uint64))
    whole = span_hash(sums, first[:-1], first[1:]) + words.astype(np.uint64)
    other = prefix_sums(mix(names ^ U64(0x5851F42D4C957F2D)), 0xC2B2AE3D27D4EB4F)
    return grams, at, words, mix(whole), span_hash(other, first[:-1], first[1:], 0xC2B2AE3D27D4EB4F)


def band_hashes(grams: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each document that has n-grams."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(full), bands), dtype=np.uint64)
    begin = at[full]
    for lo in range(0, len(full), 64):  # pieces that stay in the cache
        a, b = begin[lo], at[full[min(lo + 64, len(full)) - 1] + 1]
        piece, heads = grams[a:b], begin[lo : lo + 64] - a
        for band in range(bands):
            h = np.full(len(heads), band + 1, dtype=np.uint64)
            for k in range(band * rows, band * rows + rows):
                h = h * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat((piece ^ FLIPS[k]) * FACTORS[k], heads)
            out[lo : lo + 64, band] = mix(h)
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            grams, at, words, k1, k2 = ngrams(b.column("text"), n)
            full = np.flatnonzero(words > 0)
            values = band_hashes(grams, at, bands, rows).view(np.int64).ravel()
            offsets = np.zeros(len(words) + 1, dtype=np.int32)
            offsets[full + 1] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists], ["doc_id", "n_words", "k1", "k2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_words long, k1 long, k2 long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with v < u to (u, v) with v the least of u's component, u itself left out. Alternates large and small stars.

    A star's centre may be a third of all rows' neighbour. Least neighbours are combined before the shuffle and cut, so both
    sides of each join are plain exchanges, whose skewed partitions Spark splits.
    """
    before, edges = None, cut(edges.distinct())
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == before:
            return edges
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        near = large.join(least, "u")
        small = near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())


def compare(sets: list[np.ndarray], other: int, numer: int, denom: int) -> np.ndarray:
    """Which of the sets other.. are similar to which of the sets up to other (all to all where other is 0), as a matrix."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(n), sizes)
    grams, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = count > 1
    number = np.cumsum(some) - 1
    keep = some[inverse]
    doc, col = doc[keep], number[inverse[keep]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    total = int(some.sum())
    left = n if other == 0 else other
    common = np.zeros((left, n - other), dtype=np.float32)
    for lo in range(0, total, 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        x = np.zeros((n, min(4096, total - lo)), dtype=np.float32)
        x[doc[a:b], col[a:b] - lo] = 1
        common += x[:left] @ x[other:].T
    union = sizes[:left, None] + sizes[None, other:] - common
    return (common * denom >= union * numer) & (common > 0)


def least_label(link: np.ndarray, ids: np.ndarray, left: int, other: int) -> np.ndarray:
    """The least id of each row's component among the rows of one task."""
    label = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = label.copy()
        new[:left] = np.minimum(new[:left], np.where(link, label[None, other:], top).min(axis=1))
        new[other:] = np.minimum(new[other:], np.where(link, new[:left, None], top).min(axis=0))
        if np.array_equal(new, label):
            return label
        label = new


def buckets(classes: DataFrame, bands: int, block: int) -> DataFrame:
    """(doc_id, bucket, band, cuts): the classes of each bucket of several; of buckets of the same classes, that of the first band. cuts: into how many slices it goes."""
    held = classes.select(F.col("copy_of").alias("doc_id"), F.posexplode("bands").alias("band", "bucket"))
    same = [F.sum(F.xxhash64(F.lit(k), "doc_id").cast("decimal(20,0)")).alias(f"same{k}") for k in range(2)]
    full = held.groupBy("band", "bucket").agg(F.count("*").alias("n"), *same).where("n > 1")
    full = full.groupBy("n", "same0", "same1").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.*", F.ceil(F.col("n") / block).cast("int").alias("cuts"))
    return held.join(cut(full), ["band", "bucket"])


def similar(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), bands: int = 28, rows: int = 6, block: int = 256, few: int = 1 << 20) -> DataFrame:
    """doc_id, copy_of, class_id, n_copies, n_links for each document.

    copy_of: the smallest doc_id with the same word sequence. class_id: the smallest doc_id that a chain of links leads to.
    n_copies: documents with the same word sequence, itself included. n_links: other documents at the threshold, copies included.
    few: up to so many ids of documents in buckets are broadcast (8 bytes each) to pick their texts; more are joined.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = cut(signatures(docs, n, bands, rows).groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_words", "bands")).alias("s")).select("doc_id", "s.*"))
    worded = signed.where("n_words > 0")
    classes = cut(worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")))
    members = cut(buckets(classes, bands, block))
    ids = cut(members.select("doc_id").distinct())

    def sets(batches):
        for b in slices(batches):
            grams, at, _, k1, _ = ngrams(b.column("text"), n)
            packed = [np.unique(grams[at[i] : at[i + 1]]).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(k1.view(np.int64)), pa.array(packed, pa.binary())], ["doc_id", "k1", "grams"])

    texts = docs.join(F.broadcast(ids) if ids.count() <= few else ids, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, k1 long, grams binary")
    some = classes.join(ids.withColumnRenamed("doc_id", "copy_of"), "copy_of", "left_semi").select(F.col("copy_of").alias("doc_id"), "n_copies", "k1", "bands")
    filled = members.join(texts.dropDuplicates(["doc_id", "k1"]).join(some, ["doc_id", "k1"]), "doc_id")
    own = F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int")
    tasks = filled.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("it"))
    tasks = tasks.select("doc_id", "band", "bucket", "n_copies", "bands", "grams", "own", F.least("own", "it").alias("i"), F.greatest("own", "it").alias("j"))
    numer, denom = threshold

    def verify(t: pa.Table) -> pa.Table:
        i, j, band = (t.column(c)[0].as_py() for c in ("i", "j", "band"))
        t = t.sort_by([("own", "ascending"), ("doc_id", "ascending")])
        ids, copies = (np.asarray(t.column(c).combine_chunks()).astype(np.int64) for c in ("doc_id", "n_copies"))
        other = 0 if i == j else int(np.searchsorted(np.asarray(t.column("own").combine_chunks()), j))
        left = len(ids) if i == j else other
        links = np.zeros(len(ids), dtype=np.int64)
        label = ids
        if (i == j and len(ids) > 1) or 0 < other < len(ids):
            link = compare([np.frombuffer(g, dtype=np.uint64) for g in t.column("grams").to_pylist()], other, numer, denom)
            if i == j:
                np.fill_diagonal(link, False)
            label = least_label(link, ids, left, other)
            # Links of pairs that have met in an earlier band are counted there.
            hashes = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(len(ids), -1)[:, :band]
            x, y = np.nonzero(link)
            for lo in range(0, len(x), 65536):
                a, b = x[lo : lo + 65536], y[lo : lo + 65536]
                again = (hashes[a] == hashes[b + other]).any(axis=1)
                link[a[again], b[again]] = False
            links[:left] += link @ copies[other:]
            if i != j:
                links[other:] += copies[:left] @ link
        linked = (links > 0) | (label != ids)
        return pa.table({"doc_id": pa.array(ids[linked]), "label": pa.array(label[linked]), "links": pa.array(links[linked])})

    found = cut(tasks.groupBy("band", "bucket", "i", "j").applyInArrow(verify, "doc_id long, label long, links long"))
    labels = components(found.where("label < doc_id").select(F.col("doc_id").alias("u"), F.col("label").alias("v"))).select(F.col("u").alias("copy_of"), F.col("v").alias("label"))
    links = found.groupBy(F.col("doc_id").alias("copy_of")).agg(F.sum("links").alias("links"))
    known = classes.select("k1", "k2", "copy_of", "n_copies").join(links, "copy_of", "left").join(labels, "copy_of", "left")
    with_words = worded.select("doc_id", "k1", "k2").join(known, ["k1", "k2"]).select(
        "doc_id", "copy_of", F.coalesce("label", "copy_of").alias("class_id"), "n_copies", (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    blank = signed.where("n_words = 0").select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(blank)


def one_of_each(docs: DataFrame, keep: tuple[str, ...] = (), few: int = 1 << 20, **how) -> DataFrame:
    """doc_id, text and the columns of keep of one row of each group that chains of similar pairs connect, by row: that of the smallest doc_id.

    Rows that share a doc_id, or have none, are compared as all others; a row without words is a group of its own. few: up
    to so many numbers of rows that go are broadcast. how: as for similar().
    """
    rows = kept(docs.select("doc_id", "text", *keep, F.monotonically_increasing_id().alias("row")))
    some = cut(similar(rows.select(F.col("row").alias("doc_id"), "text"), **how).where("n_links > 0").select(F.col("doc_id").alias("row"), "class_id"))
    named = some.join(rows.select("row", "doc_id"), "row")
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select("first.row")
    gone = cut(some.join(first, "row", "left_anti").select("row"))
    return rows.join(F.broadcast(gone) if gone.count() <= few else gone, "row", "left_anti").drop("row")
