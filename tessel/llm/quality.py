"""A quality classifier: histogram gradient-boosted trees over statistics of each text, scored by vectorised traversal.

Training takes a bounded sample: of the labelled rows that the caller allows, the `max_train` of the smallest hash of
doc_id, so it's the same rows wherever they lie. Their statistics (a few KB each) are all that reaches the driver. The
trees are flattened into arrays; scoring walks all rows of a batch down all trees, one level at a time.

Defined cases: a null is an empty text, and empty texts have a score as all others (that of zero statistics); rows
without label, or of a label other than 0 and 1, aren't trained on; of rows that share a doc_id one is trained on for each
label that it has; a text of any length is read as a whole, at some 100 bytes for each of its bytes; with labels of one
value only, or none, every score is that value's (0.5 for none); columns beyond those named aren't read; an empty
table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import slices
from .textarrays import flat, word_bounds, word_names

N_BINS = 64
FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_length", "long_words", "short_words", "word_variety", "bigram_variety", "repeats_next", "top_word",
    "line_variety", "line_length", "upper", "capital_start", "all_caps", "digits", "spaces", "punctuation", "symbols", "non_ascii", "end_marks", "commas",
    "hash_symbols", "pipes", "exclaims", "quotes", "brackets", "at_signs", "slashes", "entropy", "ends_stop", "distinct_bytes",
)
KINDS = {
    "upper": range(65, 91), "digits": range(48, 58), "spaces": (32, 9, 10, 11, 12, 13), "punctuation": b".,;:!?'\"-", "symbols": b"#$%&*+<=>@^~|_`\\/",
    "non_ascii": range(128, 256), "end_marks": b".!?", "commas": b",", "hash_symbols": b"#$%&*", "pipes": b"|", "exclaims": b"!", "quotes": b"'\"", "brackets": b"()[]{}<>", "at_signs": b"@", "slashes": b"/",
}
KIND_MATRIX = np.array([[1.0 if b in set(k) else 0.0 for k in KINDS.values()] for b in range(256)])
LINE_BREAK = np.zeros(256, dtype=bool)
LINE_BREAK[10] = True


def share_distinct(rows: np.ndarray, names: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: distinct names and the count of the most frequent one."""
    order = np.lexsort((names, rows))
    r, x = rows[order], names[order]
    head = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])]) if len(r) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    count = np.diff(np.concatenate([at, [len(r)]]))
    most = np.zeros(n_rows)
    np.maximum.at(most, r[at], count)
    return np.bincount(r[at], minlength=n_rows).astype(float), most


def statistics(column) -> np.ndarray:
    """One row of FEATURES for each text; a feature sees the text only."""
    data, rows = flat(column)
    n = len(rows) - 1
    size = np.diff(rows).astype(float)
    starts, ends, first = word_bounds(data, rows)
    words = np.diff(first).astype(float)
    row = np.repeat(np.arange(n), np.diff(first))
    names, length = word_names(data, starts, ends), ends - starts
    some, some_bytes = np.maximum(words, 1), np.maximum(size, 1)
    tally = lambda flags: np.bincount(row, weights=flags, minlength=n) / some
    distinct, top = share_distinct(row, names, n)
    next_row = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    pairs, pair_row = (names[1:] * np.uint64(3) + names[:-1])[next_row], row[1:][next_row]
    pair_distinct, _ = share_distinct(pair_row, pairs, n)
    again = np.bincount(row[1:][next_row & (names[1:] == names[:-1])], minlength=n) if len(row) else np.zeros(n)
    lstart, lend, lfirst = word_bounds(data, rows, LINE_BREAK)
    lines = np.diff(lfirst).astype(float)
    lrow = np.repeat(np.arange(n), np.diff(lfirst))
    line_distinct, _ = share_distinct(lrow, word_names(data, lstart, lend), n)
    upper = (data >= 65) & (data <= 90)
    ups = np.concatenate([[0], np.cumsum(upper)])
    letters = np.concatenate([[0], np.cumsum(upper | ((data >= 97) & (data <= 122)))])
    up, letter = ups[ends] - ups[starts], letters[ends] - letters[starts]
    histogram = np.stack([np.bincount(data[rows[i] : rows[i + 1]], minlength=256) for i in range(n)]) if n else np.zeros((0, 256))
    share = histogram / some_bytes[:, None]
    kinds = dict(zip(KINDS, (share @ KIND_MATRIX).T, strict=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(np.where(share > 0, share * np.log2(share), 0), axis=1)
    last = np.zeros(n, dtype=np.uint8)
    full = np.flatnonzero(words > 0)
    last[full] = data[ends[first[full + 1] - 1] - 1]
    own = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(words), "log_lines": np.log1p(lines), "word_length": np.bincount(row, weights=length, minlength=n) / some, "long_words": tally(length > 12), "short_words": tally(length <= 2),
        "word_variety": distinct / some, "bigram_variety": (pair_distinct + (words < 2)) / np.maximum(words - 1, 1), "repeats_next": again / some, "top_word": top / some, "line_variety": line_distinct / np.maximum(lines, 1), "line_length": size / np.maximum(lines, 1),
        "capital_start": tally(upper[starts]) if len(starts) else np.zeros(n), "all_caps": tally((up >= 2) & (up == letter)), "entropy": entropy, "ends_stop": np.isin(last, list(b".!?")).astype(float), "distinct_bytes": (histogram > 0).sum(axis=1).astype(float),
    }
    return np.stack([(own | kinds)[k] for k in FEATURES], axis=1).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32)


class Trees:
    """Boosted trees as arrays: a row for each tree, a column for each node; node k has the children 2k + 1 and 2k + 2. feature -1: a leaf."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[every, np.maximum(f, 0)] > cut[node]))
            total += value[node]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, least: int = 20, smooth: float = 5.0) -> Trees:
    """Second-order boosting of the logistic loss with up to N_BINS bins for each feature."""
    nodes = 2 ** (depth + 1) - 1
    empty = np.zeros((0, nodes))
    if len(y) == 0 or y.min() == y.max():
        return Trees(0.0 if len(y) == 0 else float(np.where(y[0] == 1, 1, -1) * 6.0), empty.astype(np.int64), empty, empty)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, N_BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int64)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    features, cuts, values = [], [], []
    flat_bin = binned + np.arange(x.shape[1]) * N_BINS
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth + 1):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(node == k)
                if not len(mine):
                    continue
                g, h = grad[mine].sum(), hess[mine].sum()
                value[k] = -rate * g / (h + smooth)
                if level == depth or len(mine) < 2 * least:
                    continue
                bins = flat_bin[mine].ravel()
                shape = (x.shape[1], N_BINS)
                sums = [np.bincount(bins, weights=np.repeat(w, x.shape[1]), minlength=x.shape[1] * N_BINS).reshape(shape).cumsum(axis=1)[:, :-1] for w in (grad[mine], hess[mine], np.ones(len(mine)))]
                gain = sums[0] ** 2 / (sums[1] + smooth) + (g - sums[0]) ** 2 / (h - sums[1] + smooth) - g * g / (h + smooth)
                gain[(sums[2] < least) | (len(mine) - sums[2] < least)] = -1
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                    continue
                feature[k], cut[k] = j, edges[j][b]
                node[mine] = 2 * k + 1 + (binned[mine, j] > b)
        total += value[node]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(base, np.stack(features), np.stack(cuts), np.stack(values))


def sample_statistics(docs: DataFrame, labels: DataFrame, max_train: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most max_train labelled documents."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)

    def run(batches):
        for b in slices(batches):
            x = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most max_train rows of two numbers are broadcast, and as many of statistics come back, however often a doc_id occurs.
    rows = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, quality int, x binary")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()
    rows.sort()  # the same model whatever order the rows came in
    x = np.array([np.frombuffer(r.x, dtype=np.float32) for r in rows]).reshape(-1, len(FEATURES))
    return x, np.array([r.quality for r in rows], dtype=float)


def allowed(labels: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of doc_id as text leaves a remainder by 5; the others are held out."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def scored(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep and score for each document. labels: (doc_id, quality), all of them free to learn from."""
    trees = train(*sample_statistics(docs, labels, max_train))
    columns = ["doc_id", *(c for c in keep if c not in ("doc_id", "score"))]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in columns if c not in ("doc_id", "text")))
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in slices(batches):
            score = trees.scores(statistics(b.column("text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(score, pa.float64())], [*columns, "score"])

    return docs.mapInArrow(run, schema)
