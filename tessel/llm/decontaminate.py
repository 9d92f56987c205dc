"""Benchmark decontamination with an FM-index for each training shard.

A shard is a batch of documents. Its words are numbered by the benchmark's vocabulary; each run of other words becomes
one separator, which no phrase holds. The shard's FM-index is the Burrows-Wheeler transform of these numbers in a wavelet
matrix, with the suffix positions sampled. The benchmark's windows are searched backwards through its ranks, all windows
of a step at once; found rows are walked to a sampled position; the positions' spans are merged for each document.

The benchmark is the stated query set. It goes to the executors in parts of about `part_bytes` of text, one pass over the
documents for each part, so its broadcast has a bound; each pass adds to what the rows carry from the pass before.

Defined cases: a null or blank text has no words and is clean; an item without words has no windows; an item of fewer
words than a window is one window of all its words; repeated items each count by their item_id, and items of one id
count once; a null item_id counts as the string null; rows that share a doc_id are judged each for itself; columns beyond id,
text and those to keep aren't read; empty tables give no rows, or no hits.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import slices
from .textarrays import FOLD, runs

SAMPLE = 16


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_bits: int):
        self.n_bits, self.ranks, self.zeros = n_bits, [], []
        s = symbols
        for bit in range(n_bits - 1, -1, -1):
            ones = ((s >> bit) & 1).astype(bool)
            rank = np.zeros(len(s) + 1, dtype=np.int32)
            np.cumsum(ones, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(len(s) - int(rank[-1]))
            s = np.concatenate([s[~ones], s[ones]])
        self.starts = {}

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of symbol[i] are before at[i]."""
        begin = np.zeros(len(at), dtype=np.int64)
        for level, bit in enumerate(range(self.n_bits - 1, -1, -1)):
            one = ((symbol >> bit) & 1).astype(bool)
            r, z = self.ranks[level], self.zeros[level]
            a, b = r[at], r[begin]
            at = np.where(one, z + a, at - a)
            begin = np.where(one, z + b, begin - b)
        return at - begin


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array. Separators (0) count as distinct and increasing, so comparisons end at them; prefix doubling on what is still tied."""
    n = len(symbols)
    zero = symbols == 0
    rank = symbols.astype(np.int64) + n
    rank[zero] = np.arange(int(zero.sum()))
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    tied = ~head
    tied[:-1] |= ~head[1:]
    place = np.flatnonzero(tied)
    step = 1
    while len(place):
        pos = order[place]
        nxt = pos + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        both = rank[pos] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        pos, both = pos[by], both[by]
        order[place] = pos
        head = np.concatenate([[True], both[1:] != both[:-1]])
        rank[pos] = place[head][np.cumsum(head) - 1]
        tied = ~head
        tied[:-1] |= ~head[1:]
        place = place[tied]
        step *= 2
    return order


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        n = len(symbols)
        order = suffix_order(symbols)
        self.bwt = symbols[order - 1]  # order - 1 of 0 is the last symbol, a separator
        self.matrix = WaveletMatrix(self.bwt, max(1, int(n_symbols - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        sampled = (order % SAMPLE == 0) | (self.bwt == 0)  # walks never step over a separator
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled, self.samples = sampled, order[sampled]
        self.n = n

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned windows."""
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), self.n, dtype=np.int64)
        live = np.arange(len(windows))
        for k in range(1, windows.shape[1] + 1 if len(windows) else 1):
            live = live[(lengths[live] >= k) & (low[live] < high[live])]
            if not len(live):
                break
            c = windows[live, -k]
            low[live] = self.before[c] + self.matrix.rank(c, low[live])
            high[live] = self.before[c] + self.matrix.rank(c, high[live])
        return low, np.maximum(high, low)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of rows, by steps back to a sampled one."""
        row, out, walked = row.copy(), np.empty(len(row), dtype=np.int64), 0
        todo = np.arange(len(row))
        while len(todo):
            done = self.sampled[row[todo]]
            out[todo[done]] = self.samples[self.sampled_before[row[todo[done]]]] + walked
            todo = todo[~done]
            c = self.bwt[row[todo]]
            row[todo] = self.before[c] + self.matrix.rank(c, row[todo])
            walked += 1
        return out


class Phrases:
    """The benchmark's windows over its own vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.number, seen = {}, {}
        self.items = sorted({i for i, _ in items})
        number_of = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            words = words_of(text)
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                seen.setdefault(tuple(ids[k : k + window]), set()).add(number_of[item])
        self.windows = np.zeros((len(seen), window), dtype=np.int32)
        self.lengths = np.zeros(len(seen), dtype=np.int64)
        self.holders = []
        for k, (w, holders) in enumerate(seen.items()):
            self.windows[k, window - len(w) :] = w
            self.lengths[k] = len(w)
            self.holders.append(sorted(holders))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def shard_hits(texts: list[str | None], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text: its words, merged spans of hit words, and the items with an occurring window."""
    get, numbers, sizes = phrases.number.get, [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        numbers.append(np.fromiter(map(get, words, [0] * len(words)), dtype=np.int32, count=len(words)))
        numbers.append(np.zeros(1, np.int32))  # ends the document
    spans, items = [[] for _ in texts], [[] for _ in texts]
    flat = np.concatenate(numbers)
    at = np.flatnonzero(np.concatenate([[True], (flat[1:] != 0) | (flat[:-1] != 0)]))  # one separator for each run
    symbols = flat[at]
    first = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
    if not len(phrases.windows) or not symbols.any():
        return sizes, spans, items
    index = FMIndex(symbols, len(phrases.number) + 1)
    low, high = index.search(phrases.windows, phrases.lengths)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    found = at[index.locate(rows)]
    steps = np.zeros(len(flat) + 1, dtype=np.int32)
    np.add.at(steps, found, 1)
    np.add.at(steps, found + phrases.lengths[which], -1)
    doc = np.searchsorted(first, found, side="right") - 1
    for start, end in zip(*runs(np.cumsum(steps[:-1]) > 0), strict=True):
        d = int(np.searchsorted(first, start, side="right")) - 1
        spans[d].append((int(start - first[d]), int(end - first[d])))
    for pair in np.unique(doc * len(phrases.windows) + which).tolist():
        d, w = divmod(pair, len(phrases.windows))
        items[d].extend(phrases.holders[w])
    return sizes, spans, [[phrases.items[k] for k in sorted(set(x))] for x in items]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, part_bytes: int = 16_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, spans (start and end word of the merged hits), items (ids as sorted strings) and the columns of keep for each document."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    keep = tuple(c for c in keep if c not in ("doc_id", "text", "n_words", "spans", "items"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    span_type = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    found = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span_type)), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*rows.schema.fields, *found])

    def one_pass(rows: DataFrame, part: int) -> DataFrame:
        """Adds what this part of the benchmark finds to what the parts before it have found."""
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([(r.item, r.text) for r in own.toLocalIterator()])

        def run(batches):
            phrases = Phrases(shared.value, window)
            for b in slices(batches):
                n, spans, found = shard_hits(b.column("text").to_pylist(), phrases)
                if part:
                    before = [[(s["start"], s["end"]) for s in x] for x in b.column("spans").to_pylist()]
                    spans = [merged(x + y) for x, y in zip(before, spans, strict=True)]
                    found = [sorted({*x, *y}) for x, y in zip(b.column("items").to_pylist(), found, strict=True)]
                spans = [[{"start": s, "end": e} for s, e in x] for x in spans]
                names = ["doc_id", "text", *keep]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))], [*names, "n_words", "spans", "items"])

        return rows.mapInArrow(run, schema)

    for part in range(parts):
        rows = one_pass(rows, part)
    return rows


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def judged(found: DataFrame) -> DataFrame:
    """hits() with n_hit, n_items and contaminated: at least a twentieth of the words are hit."""
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
