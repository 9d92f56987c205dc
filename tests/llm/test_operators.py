"""Each operator against a brute-force version, on small fixtures with the odd cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.llm import chat_tree, decontaminate, edit_counts, lineage, maxscore, ngram_join, owners, piece_bpe, quality, recompress, suffix_dedup, url_filter

P = pytest.importorskip("public_tokenizers")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, block string, spans int, score string"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def fold(text):
    return FOLDED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abdeortuéß聖") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(300)
    near = base.split()
    near[150] = "changed"
    texts = [prose(80), passage, prose(40) + " " + passage + " " + prose(40), base, base, " ".join(near), base + " more", passage + "\n" + passage, None, "", " \t\n", "one", "a b c d e f g h i j k l m", "A B c d e f g h i j k l m",
             "x " * 400, "ab" * 300, prose(30000), base.upper(), base.upper(), "the same line\n" * 40, "the same line\n" * 30, "\0" * 250]
    rows = [(i * 7 % 101, t, "b", 1, "s") for i, t in enumerate(texts)]
    return [*rows, (None, passage, "b", 1, "s"), rows[3], (rows[4][0], prose(20), "b", 1, "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def test_decontamination(spark, docs, empty):
    items = [(1, corpus()[1][1]), (2, "A b c D e f g h i j k l m n"), (3, None), (4, "one"), (5, "!!"), (5, "one"), (None, "one"), (6, " ".join(corpus()[0][1].split()[10:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("extra", F.lit(1))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add("null" if i is None else str(i))
    expected = []
    for i, t, *_ in corpus():
        w, hit, found = fold(t), set(), set()
        for x, held in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= held
        expected.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    for part_bytes in (1 << 20, 60):
        got = decontaminate.judged(decontaminate.hits(docs, bench, part_bytes=part_bytes, keep=("block",))).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=str) == sorted(expected, key=str)
        assert {r.block for r in got} == {"b"}
    assert decontaminate.hits(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.judged(decontaminate.hits(docs, bench.limit(0))).collect()} == {0}


def test_fm_index():
    rnd = np.random.default_rng(2)
    for size, letters in ((1, 2), (60, 3), (500, 6)):
        s = np.concatenate([rnd.integers(0, letters, size), [0]]).astype(np.int32)
        index = decontaminate.FMIndex(s, letters)
        patterns = [rnd.integers(1, letters, n) for n in (1, 2, 3, 5) for _ in range(10) if letters > 1]
        windows = np.zeros((len(patterns), 5), dtype=np.int32)
        for k, p in enumerate(patterns):
            windows[k, 5 - len(p) :] = p
        low, high = index.search(windows, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(s)) if s[i : i + len(p)].tolist() == p.tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("window,block_bytes,many", [(13, 8 << 20, 256), (13, 3000, 256), (13, 3000, 1), (5, 2000, 2)])
def test_recompression(docs, empty, window, block_bytes, many):
    first, expected = {}, []
    for i, t, *_ in sorted(corpus(), key=lambda r: order(r[0])):
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), order(i))
    for i, t, *_ in corpus():
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        expected.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    got = recompress.removed_words(docs, window, block_bytes, many).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected, key=str)
    assert recompress.removed_words(empty).count() == 0


def parsed(spark, texts, window=13, owners=3):
    """Each text as a block of its own, parsed to the last round."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = {r.block: r.asDict() for r in recompress.packed(docs, 1).collect()}
    blocks, answers = {b: recompress.Parse(r, window) for b, r in rows.items()}, {}
    for k in range(recompress.ROUNDS + 1):
        asked = [(b, o, x) for b, p in blocks.items() for o, x in p.asked(k, owners)]
        got = recompress.names(spark.createDataFrame(asked, recompress.ASK), k, 256).collect()
        for b, p in blocks.items():
            answers[b, k] = {r.owner: bytes(r.answer) for r in got if r.block == b}
            p.learn(k, owners, answers[b, k])
        if k == recompress.CARRY - 1:
            blocks = {b: recompress.Parse.resumed(p.carried(), window) for b, p in blocks.items()}
    for b, p in blocks.items():
        p.with_words(rows[b], answers[b, 0], owners)
    return [p for _, p in sorted(blocks.items())]


@pytest.fixture(scope="module")
def around_a_core(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    core = rnd.choices(words, k=30) + ["same"] * 5 + rnd.choices(words, k=30) + ["a", "b"] * 12
    texts = [rnd.choices(words, k=rnd.randint(0, 40)) + core + rnd.choices(words, k=rnd.randint(0, 40)) for _ in range(5)]
    return core, texts, parsed(spark, [" ".join(t) for t in texts])


def test_names_are_global(around_a_core):
    _, texts, blocks = around_a_core
    content, name = {}, {}
    for t, p in zip(texts, blocks, strict=True):
        for s in p.kinds:
            for n, i, j in zip(s.name.tolist(), s.start.tolist(), s.end.tolist(), strict=True):
                assert content.setdefault(n, tuple(t[i:j])) == tuple(t[i:j]) and name.setdefault(tuple(t[i:j]), n) == n
    assert ("same",) * 5 in name and max(map(len, name)) >= 4


def test_equal_windows_have_equal_anchors(around_a_core):
    core, texts, blocks = around_a_core
    seen = []
    for t, p in zip(texts, blocks, strict=True):
        at = next(i for i in range(len(t)) if t[i : i + len(core)] == core)
        w = p.windows()
        inside = (w.at >= at) & (w.at + 13 <= at + len(core))
        assert inside.sum() == len(core) - 12  # all of the core's windows are in question
        seen.append((w.name[inside].tolist(), w.skip[inside].tolist(), w.size[inside].tolist()))
    assert all(x == seen[0] for x in seen)
    assert np.mean(np.array(seen[0][2]) > 1) > 0.9


def test_pairs_of_one_route_are_told_apart(spark, monkeypatch):
    texts = [" ".join(random.Random(i % 2).choices("abcdefghij", k=60)) for i in range(4)]
    usual = [[s.name.tolist() for s in p.kinds] for p in parsed(spark, texts)]
    monkeypatch.setattr(recompress, "route", lambda a, b: np.full(len(a), 5, np.uint64))
    alike = [[s.name.tolist() for s in p.kinds] for p in parsed(spark, texts)]
    assert usual[0] == usual[2] and alike[0] == alike[2] and alike[1] == alike[3]
    for p in (usual, alike):
        assert len({n for k in p[0][1:2] for n in k}) > 5
    assert [len(set(k)) for k in usual[0][:2]] == [len(set(k)) for k in alike[0][:2]]  # later coins depend on names


def test_windows_are_verified_at_their_anchors(around_a_core, monkeypatch):
    """An anchor counts by its name alone, what stands beside it by its words; equal hashes decide nothing."""
    _, _, blocks = around_a_core
    w = blocks[0].windows()
    kind = w.kinds()
    n, skip, size = len(kind), w.skip, w.size
    assert 0 < kind.max() + 1 < n  # the core's last part repeats within itself
    flat = np.concatenate([w.word[a : a + 13] for a in w.at])
    apart = recompress.Windows(flat, np.arange(n) * 13, w.name, skip, size, 13)
    same_kinds = lambda x: len(set(zip(kind.tolist(), x.tolist(), strict=True))) == kind.max() + 1 == x.max() + 1
    assert same_kinds(apart.kinds())
    under = (np.arange(n * 13) % 13 >= np.repeat(skip, 13)) & (np.arange(n * 13) % 13 < np.repeat(skip + size, 13))
    assert same_kinds(recompress.Windows(np.where(under, np.uint64(7), flat), apart.at, w.name, skip, size, 13).kinds())
    one_name = recompress.Windows(np.where(under, np.uint64(7), flat), apart.at, np.ones(n, np.uint64), skip, size, 13)
    assert one_name.kinds().max() <= kind.max()
    monkeypatch.setattr(recompress.Windows, "hashes", lambda self: np.zeros(len(self.at), np.uint64))
    assert same_kinds(apart.kinds())


def test_suffix_array():
    rnd = np.random.default_rng(5)
    for letters in (1, 2, 4, 200):
        for n in (0, 1, 2, 50, 400):
            data = rnd.integers(1, letters + 1, n).astype(np.uint8)
            b = data.tobytes()
            for depth in (8, 20, 1000):
                wanted = rnd.random(n) < 0.3
                for sa, places in ((suffix_dedup.suffix_array(data, depth), range(n)), (suffix_dedup.suffix_array(data, depth, wanted), np.flatnonzero(wanted))):
                    assert sorted(sa.tolist()) == list(places)
                    assert all(b[x : x + depth] <= b[y : y + depth] for x, y in itertools.pairwise(sa))
            sa = suffix_dedup.suffix_array(data, 1000)
            same = suffix_dedup.equal_neighbours(sa, data, 11)
            assert same.tolist() == [len(b[x : x + 11]) == 11 and b[x : x + 11] == b[y : y + 11] for x, y in itertools.pairwise(sa)]


def ranked(i, text):
    """The order of rows: doc_id, then Spark's hash of the text."""
    return (*order(i), TIES[text])


TIES = {}


def brute_bytes(length):
    seen, out = set(), []
    for i, t, *_ in sorted(corpus(), key=lambda r: ranked(r[0], r[1])):
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        out.append((i, b, gone))
    return out


def learn_ties(docs):
    TIES.update({r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()})


@pytest.mark.parametrize("length,block_bytes,many", [(100, 8 << 20, 256), (100, 5000, 256), (100, 5000, 1), (20, 3000, 2)])
def test_suffix_dedup(docs, empty, length, block_bytes, many):
    learn_ties(docs)
    expected = [(i, len(b), sum(g), len(re.findall(b"\1+", g)), bytes(x for x, y in zip(b, g, strict=True) if not y)) for i, b, g in brute_bytes(length)]
    got = suffix_dedup.removed_bytes(docs, length, block_bytes, many).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str) == sorted(expected, key=str)
    assert suffix_dedup.removed_bytes(empty, length).count() == 0


def test_every_removal_comes_from_a_suffix_array(monkeypatch):
    """Blocks and owners, as Spark runs them: without equal neighbours in the arrays nothing is removed, whatever the hashes say."""
    texts = [t or "" for _, t, *_ in corpus()]
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts, "tie": [0] * len(texts)})

    def removed():
        b = suffix_dedup.Block(table, 100)
        none = pa.table({"owner": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})
        return len(b.local(none, 3)[0])

    assert removed() > 5000
    monkeypatch.setattr(suffix_dedup, "equal_neighbours", lambda sa, data, length: np.zeros(max(0, len(sa) - 1), bool))
    assert removed() == 0


def test_equal_hashes_remove_nothing(spark, monkeypatch):
    """If all grams had one hash, all strings would meet in one owner, and bytes would still decide."""
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: np.zeros(len(x), np.uint64))
    learn_ties(spark.createDataFrame(corpus(), SCHEMA))
    table = pa.table({"doc_id": [1, 2], "text": ["a" * 150 + "b" * 200, "b" * 120 + "c" * 300], "tie": [0, 0]})
    blocks = [suffix_dedup.Block(table.slice(i, 1), 100) for i in range(2)]
    both = np.packbits([True]).tobytes() + np.packbits([False]).tobytes()
    told = pa.table({"owner": pa.array([0], pa.int32()), "bits": pa.array([both], pa.binary())})
    messages = []
    for b in blocks:
        key, start, count = b.items(b.local(told, 1)[1], told, 1)
        assert set(key.tolist()) == {0}
        messages.append((start, count, suffix_dedup.message(b, start, count)))
    asked = spark.createDataFrame([(i, 0, m) for i, (_, _, m) in enumerate(messages)], "block int, owner int, items binary")
    bits = {r.block: np.unpackbits(np.frombuffer(r.bits, np.uint8), count=int(messages[r.block][1].sum())) for r in suffix_dedup.earlier(asked, 100).collect()}
    assert bits[0].sum() == 0 and bits[1].sum() == 1  # of the second text's b strings the first ones; only one is new to its own text


def test_texts_longer_than_a_piece(docs):
    rnd = random.Random(3)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    long = "x" * (suffix_dedup.PIECE + 5000) + passage + "".join(rnd.choice("abcdefgh ") for _ in range(suffix_dedup.PIECE)) + passage
    rows = docs.sparkSession.createDataFrame([(2, long), (1, passage)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, [(s.start, s.end) for s in r.spans]) for r in suffix_dedup.removed_bytes(rows, block_bytes=1000).collect()}
    first = suffix_dedup.PIECE + 5000
    assert got[1] == (0, []) and got[2][1] == [(1, first + 700), (len(long) - 700, len(long))]


def test_whole_characters_go(spark):
    # Two texts share 100 bytes that begin and end within characters.
    a, b = "é" * 80, "x" + "é" * 60
    rows = spark.createDataFrame([(1, a, 1), (2, b, 1)], "doc_id long, text string, other int")
    got = {r.doc_id: r.text for r in suffix_dedup.shortened(rows).collect()}
    assert got[2] == "x" and set(got[1]) <= {"é"}


def test_join(spark, docs, empty):
    sets, copies = {}, {}
    for i, t, *_ in corpus():
        if i is not None:
            w = fold(t)
            copies.setdefault(i, []).append(tuple(w))
    single = {i: w[0] for i, w in copies.items() if len(set(w)) == 1}  # ids of several texts count with one of them
    sets = {i: frozenset(w[k : k + 5] for k in range(max(1, len(w) - 4))) if w else frozenset() for i, w in single.items()}
    rows = docs.where(F.col("doc_id").isin(list(single)) | F.col("doc_id").isNull())
    links = {(a, b) for a, b in itertools.permutations(sets, 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4}
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            label[a] = min(label[a], label[b])
    for block, few in ((512, 1 << 20), (2, 0)):
        got = {r.doc_id: r for r in ngram_join.similar(rows, block=block, few=few).collect()}
        assert set(got) == set(sets)
        assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (label[i], sum(a == i for a, _ in links)) for i in sets}
    assert sum(a == 21 for a, _ in links) >= 2  # the fixture has links
    assert ngram_join.similar(empty).count() == 0
    assert len({r.doc_id for r in ngram_join.similar(docs).collect()}) == len(copies)


def test_recall_of_bands(spark):
    """Pairs at the threshold and a little above it: no link of a few hundred is lost."""
    rnd, rows, expected = random.Random(21), [], set()
    for i in range(150):
        words = [f"v{rnd.randrange(100000)}" for _ in range(rnd.randint(60, 200))]
        near = list(words)
        for _ in range(2):  # each change takes away up to five n-grams
            near[rnd.randrange(len(near))] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, near))
        if 5 * len(a & b) >= 4 * len(a | b):
            expected.add((2 * i, 2 * i + 1))
    got = {(r.class_id, r.doc_id) for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links > 0 and doc_id > class_id").collect()}
    assert len(expected) > 50 and got <= expected and len(got) >= 0.99 * len(expected)


def test_components(spark):
    edges = [(2, 1), (3, 2), (9, 3), (7, 5), (8, 7), (20, 8), *((i + 1, i) for i in range(100, 140))]
    got = {r.u: r.v for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 7: 5, 8: 5, 20: 5} | {i: 100 for i in range(101, 141)}


def test_max_score(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.normal(size=8).round(1).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(15)] + [(1100, [0.5] * 8), (1200, None), (1300, [None] * 8), (1400, [float("nan")] * 8), (1500, [float("inf")] * 8), (None, [1.0] * 8), (7, [9.0] * 8), (0, [0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    sound = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 1024).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    expected = set()
    for q in sorted({i for i, _ in sound if i % 100 == 0}):
        w = min((v.tolist() for i, v in sound if i == q))
        best = sorted((-int(v @ np.array(w)), i) for i, v in sound if i != q)[:10]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    for block, query_block in ((8192, 1024), (40, 2)):
        got = [tuple(r) for r in maxscore.top_k(table, table.where("vec_id % 100 = 0"), block=block, query_block=query_block).collect()]
        assert len(got) == len(expected) and set(got) == expected
    assert maxscore.top_k(table.limit(0), table).count() == 0 and maxscore.top_k(table, table.limit(0)).count() == 0
    assert maxscore.top_k(table.where("vec_id < 3"), table.where("vec_id = 1")).count() == 3


def test_the_split_moves():
    """The non-essential terms' bounds stay below the k-th best score, more terms become non-essential as it rises, and few vectors are probed."""
    rnd = np.random.default_rng(3)
    ids, weights = np.arange(5000), rnd.integers(-1000, 1000, (32, 5000)) * (0.93 ** np.arange(32))[:, None]
    weights = np.floor(weights)
    queries, trace = np.floor(rnd.integers(-1000, 1000, (3, 32)).astype(float)), []
    number, found, score = maxscore.shard_top(ids, weights, np.array([7, -1, -2]), queries, np.full(3, np.nan), 10, trace=trace)
    for k, own in enumerate((7, -1, -2)):
        want = sorted((-s, i) for i, s in enumerate(queries[k] @ weights) if i != own)[:10]
        assert sorted(zip((-score[number == k]).tolist(), found[number == k].tolist(), strict=True)) == want
        essential = [e for n, _, e, _ in trace if n == k]
        assert essential[0] == 32 and essential[1] < 20 and essential == sorted(essential, reverse=True)
    assert len({(n, e) for n, step, e, _ in trace if step}) > 3  # within a shard the split moves on
    best = np.array([score[number == k].max() for k in range(3)])
    assert len(maxscore.shard_top(ids, weights, np.array([7, -1, -2]), queries, best + 1, 10)[0]) == 0
    bound = np.abs(queries * 2.0**60).sum()
    trace.clear()
    assert len(maxscore.shard_top(ids, weights, np.array([7]), queries[:1], np.array([bound]), 10, trace=trace)[0]) == 0 and not trace  # the whole shard is skipped


def test_edit_counts(spark, docs, empty):
    ranks = P.path("byte_bpe_50k.tiktoken")
    counter = edit_counts.Counter(ranks, P.PATTERN)
    rnd, alphabet = random.Random(8), "ab '  \n\t1!lsrevd聖é"
    for _ in range(300):
        tree = edit_counts.CountTree("".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 3, 60, 900]))), counter)
        for _ in range(5):
            at = rnd.randint(-1, len(tree.text) + 2)
            tree.edit(at, at + rnd.choice([0, 1, 2, 5, 100]), "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 2, 7, 200]))))
            assert tree.leaves()[0] == [len(m) for m in counter.pattern.findall(tree.text)]
            assert tree.n_tokens == len(counter.encoding.encode_ordinary(tree.text))
    change = lambda s, e, r: F.struct(F.lit(s).cast("long").alias("start"), F.lit(e).cast("long").alias("end"), F.lit(r).cast("string").alias("replacement"))
    trees = lineage.kept(edit_counts.built(docs, ranks, P.PATTERN))
    first = edit_counts.edited(trees.withColumn("edits", F.array(change(5, 9, "x y"), change(None, None, None), change(99999999, 3, "!"))), ranks, P.PATTERN)
    second = edit_counts.edited(lineage.kept(first.withColumn("edits", F.array(change(0, 1, "new ")))), ranks, P.PATTERN)
    for rows, end in ((first.collect(), "!"), (second.collect(), "!")):
        assert len(rows) == len(corpus())
        for r in rows:
            assert r.n_tokens == len(counter.encoding.encode_ordinary(r.text)) and r.text.endswith(end) and r.n_encoded <= 40
            assert np.frombuffer(r.chars, "<u4").tolist() == [len(m) for m in counter.pattern.findall(r.text)] and np.frombuffer(r.tokens, "<u4").sum() == r.n_tokens
    same = edit_counts.edited(trees.withColumn("edits", F.lit(None)), ranks, P.PATTERN).collect()
    assert {r.n_encoded for r in same} == {0} and sorted((r.doc_id, r.n_tokens) for r in same if r.doc_id) == sorted((r.doc_id, r.n_tokens) for r in trees.collect() if r.doc_id)
    assert edit_counts.edited(edit_counts.built(empty, ranks, P.PATTERN).withColumn("edits", F.lit(None)), ranks, P.PATTERN).count() == 0


def test_kept_trees_encode_only_what_edits_touch(monkeypatch):
    counter = edit_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "some words, and more of them " * 500
    kept = edit_counts.CountTree(text, counter).leaves()
    encoded = []
    counts = counter.counts
    monkeypatch.setattr(counter, "counts", lambda pieces: encoded.extend(pieces) or counts(pieces))
    tree = edit_counts.CountTree(text, counter, kept)
    assert encoded == [] and tree.leaves() == kept
    tree.edit(7000, 7003, "other text")
    assert 0 < len(encoded) < 10 and tree.n_tokens == len(counter.encoding.encode_ordinary(tree.text))


def test_a_pattern_that_looks_far_ahead():
    """Its pre-tokens' ends depend on more than four characters behind them; a larger context is right."""
    counter = edit_counts.Counter(P.path("byte_bpe_50k.tiktoken"), r"\s*[\r\n]+|" + P.PATTERN)
    tree = edit_counts.CountTree("word" + " " * 9 + "end", counter, context=64)
    tree.edit(13, 13, "\n")
    assert tree.leaves()[0] == [len(m) for m in counter.pattern.findall(tree.text)]


def test_sentencepiece(docs, empty):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=model), piece_bpe.Codec(model, remember=50)
    rnd, alphabet = random.Random(9), "ab e\n\t▁ éß聖𐍈́​\xa0'.<>0x\x00\x01A😀-=*#"
    texts = ["", " ", "  ", "▁", "a" * 500, " " * 100 + "x", "</s><s>", "\r\n", "ﬁ ① Ａ", "springframeworkation"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    for text in texts:
        parts, ids = codec.encode(text), lib.encode(text)
        assert [int(i) for p in parts for i in p[0].split(",")] == ids and "".join(p[1] for p in parts)[1:] == lib.decode(ids)
    got = piece_bpe.encoded(docs, model).collect()
    expected = [(i, lib.encode(t or "")) for i, t, *_ in corpus()]
    assert sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in got), key=str) == sorted(((i, len(x), ",".join(map(str, x)), lib.decode(x)) for i, x in expected), key=str)
    assert piece_bpe.encoded(empty, model).count() == 0


def test_other_kinds_of_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        plain = f.read()
    changes = {
        None: lambda m: None,
        "a model type other than merges": lambda m: setattr(m.trainer_spec, "model_type", m.trainer_spec.UNIGRAM),
        "space marks behind words": lambda m: setattr(m.trainer_spec, "treat_whitespace_as_suffix", True),
        "a normaliser": lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True),
        "pieces defined by a user": lambda m: setattr(m.pieces[-1], "type", m.pieces[-1].USER_DEFINED),
    }
    for reason, change in changes.items():
        model = sentencepiece_model_pb2.ModelProto.FromString(plain)
        change(model)
        assert piece_bpe.foreign(model) == reason


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "dup.org", "/"), ("allow", "dup.org", "/"), ("block", "deep.org", "/a/b")]


def brute_url(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], "block" if max(fits)[1] == "dup.org/" else max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls(spark):
    rnd = random.Random(10)
    hosts = ["com", "a.com", "EXAMPLE.com", "www.example.com", "x.www.example.com", "notexample.com", "b.net", "net", "x.dup.org", "deep.org", "com.", "", "é.NET", "a..com", "com:80", "u@a.com"]
    urls = [None, "", "no scheme", "://", "http://", "http://a.com", "http://a.com?x=://b.net/es/", "x://b.net/es/://c"] + [f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en', '/en/x?y#z', '/es/1', '/fr/', '?q', '#f', '/a/b', '/a/bc', '/a'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, RULES).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, RULES, chunk=2).collect()} == got
    assert {r.verdict for r in url_filter.judged(pages, [], default="block").collect()} == {"block"}
    more = url_filter.judged(pages.withColumn("best", F.col("page_id")).withColumn("key", F.lit("k")), RULES)
    assert all(r.best == r.page_id and r.key == "k" and got[r.page_id] == (r.host, r.path, r.rule, r.verdict) for r in more.collect())
    assert url_filter.judged(pages.limit(0), RULES).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.where("cast(substring(key, 4) as int) % 97 = 0")
    cascade = url_filter.Cascade(listed, universe, listed.count(), 20000)
    wrong = universe.where(cascade.lists(F.col("key")) != (F.substring("key", 4, 9).cast("int") % 97 == 0))
    assert len(cascade.levels) > 1 and wrong.count() == 0
    assert sum(bits for _, bits, _ in cascade.levels) < 40 * 207


def test_linear_chats(spark):
    texts = ["hi", None, "", "<|im_end|>", "<\\|x", "a<|im_start|>b<\\\\|c\n", "<", "|", "\\", "\n\n", "x" * 5000]
    rows = [(c, t, ("user", "assistant", "system", None)[(t + c) % 4], texts[(c * 3 + t) % len(texts)]) for c in range(9) for t in range(c * 5 + 1)] + [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 0, "user", "x"), (77, None, "assistant", "late")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {r.tree: r for r in chat_tree.read_back(chat_tree.formatted(chat_tree.linear(table))).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            groups[c].append((t is not None, t or 0, role or "", text or "", role is not None))
    assert set(got) == set(groups)
    for c, g in groups.items():
        turns = [(r, x) for _, _, r, x, _ in sorted(g, key=lambda x: (x[0], x[1], x[4] and x[2] != "", x[2], x[3]))]
        assert [tuple(t) for t in got[c].turns] == turns
        assert list(got[c].learned) == [x for r, x in turns if r == "assistant"]
        assert got[c].conversation.count("<|im_start|>") == got[c].conversation.count("<|im_end|>") == len(turns)
    assert chat_tree.formatted(chat_tree.linear(table.limit(0))).count() == 0


def test_roles_come_back(spark):
    roles = ["a\nb", "%0A", "%", "%25\n", "<|im_end|>\n", "user"]
    table = spark.createDataFrame([(i, 1, r, "c\nd") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = {r.tree: [tuple(t) for t in r.turns] for r in chat_tree.read_back(chat_tree.formatted(chat_tree.linear(table))).collect()}
    assert got == {i: [(r, "c\nd")] for i, r in enumerate(roles)}


def test_long_conversations(spark):
    table = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id) as text")
    (r,) = chat_tree.read_back(chat_tree.formatted(chat_tree.linear(table))).collect()
    assert len(r.turns) == 20_000 and list(r.learned) == [f"text {i}" for i in range(1, 20_000, 2)]


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "good"), (1, 3, 1, 0.5, "assistant", "fair"), (1, 4, 2, 0.0, "user", "more"), (1, 5, 3, 3.0, "user", "best"), (2, 1, 9, None, "user", "orphan"), (3, 1, 2, 1.0, "user", "cycle"), (3, 2, 1, 1.0, "user", "cycle"),
            (4, 1, 1, 1.0, "user", "self"), (1, 5, 3, 3.0, "user", "best"), (None, 1, None, 1.0, "user", "x")]
    table = spark.createDataFrame(rows, "tree long, id long, parent long, score double, role string, text string")
    got = {(r.tree, r["rank"]): [t.text for t in r.turns] for r in chat_tree.read_back(chat_tree.formatted(table, per_tree=5)).collect()}
    assert got == {(1, 1): ["q", "fair", "best"], (1, 2): ["q", "good", "more"], (2, 1): ["orphan"]}
    assert {(r.tree, r.path) for r in chat_tree.formatted(table).collect()} == {(1, 5), (2, 1)}


def test_quality(spark):
    rnd = random.Random(12)
    words = ["stone", "river", "walks", "quietly", "under", "the", "bright", "morning", "of", "and", "we"]
    good = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(20, 90))) + "."
    bad = lambda: rnd.choice([lambda: "BUY!! NOW!! " * rnd.randint(5, 30), lambda: (rnd.choice(words) + " ") * 40, lambda: " ".join(w + "###" for w in rnd.choices(words, k=40))])()
    rows = [(i, bad() if i % 4 == 0 else good(), "x") for i in range(600)] + [(600, None, "x"), (601, "", "x"), (None, "y", "x"), (602, "z" * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(600)] + [(600, None), (None, 1), (5, 7)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.scored(docs, quality.allowed(labels)).collect()}
    held = [i for i in range(600) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == (i % 4 != 0) for i in held]) > 0.95
    assert got == {r.doc_id: r.score for r in quality.scored(docs.repartition(7), quality.allowed(labels)).collect()}
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert min(r.score for r in quality.scored(docs, labels.where("quality = 1")).collect()) > 0.9
    x = quality.statistics(pa.array([None, "", "a", "A b! 1\nc"], pa.string()))
    assert x.shape == (4, len(quality.FEATURES)) and np.isfinite(x).all()


def test_training_is_a_brute_force_search():
    """Trees as an exhaustive search over all cuts builds them, and scores as a walk of one row at a time gives them."""
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 12, (90, 3)).astype(np.float32)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7) ^ (rnd.random(90) < 0.1)).astype(float)
    rounds, depth, rate, least, smooth = 4, 2, 0.3, 6, 2.0
    trees = quality.train(x, y, rounds, depth, rate, least, smooth)
    total = np.full(90, np.log(y.mean() / (1 - y.mean())))

    def grow(rows, grad, hess, level):
        g, h, best = grad[rows].sum(), hess[rows].sum(), None
        if level < depth and len(rows) >= 2 * least:
            for j in range(3):
                for cut in sorted({float(v) for v in x[:, j]})[:-1]:
                    low, high = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    if min(len(low), len(high)) >= least:
                        gain = sum(grad[r].sum() ** 2 / (hess[r].sum() + smooth) for r in (low, high)) - g * g / (h + smooth)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = gain, j, cut, low, high
        if best is None:
            return -rate * g / (h + smooth)
        return best[1], best[2], grow(best[3], grad, hess, level + 1), grow(best[4], grad, hess, level + 1)

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
        return tree

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = grow(np.arange(90), p - y, p * (1 - p), 0)
        total += [walk(tree, row) for row in x]
    assert np.allclose(trees.scores(x), 1 / (1 + np.exp(-total)), atol=1e-9)
    for row in x[:10]:  # the arrays, node by node
        raw = trees.base
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value, strict=True):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            raw += value[node]
        assert np.isclose(1 / (1 + np.exp(-raw)), trees.scores(row[None])[0])


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(300)] + [(2, "other")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    x, y = quality.sample_statistics(docs, labels, 3)
    assert len(x) == len(y) <= 3
    x, y = quality.sample_statistics(docs, labels, 100)
    assert len(y) == 3  # one row for each doc_id and label
    empty = docs.limit(0)
    assert quality.scored(empty, labels).count() == 0 and quality.scored(docs, labels.limit(0)).count() == 350


def test_one_of_each_group(spark):
    prose = [" ".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=60)) for i in range(4)]
    rows = [(5, prose[0]), (3, prose[0]), (3, prose[0]), (None, prose[0]), (None, prose[1]), (None, prose[1]), (7, prose[2]), (7, prose[3]), (8, None), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, other int").repartition(3)
    for few in (1 << 20, 0):
        got = [(r.doc_id, r.text) for r in ngram_join.one_of_each(docs, ("other",), few=few).collect()]
        want = [(3, prose[0]), (None, prose[1]), (7, prose[2]), (7, prose[3]), (8, None), (8, None), (9, "")]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert ngram_join.one_of_each(docs.limit(0), ("other",)).count() == 0


def test_packed_questions(spark):
    x = np.array([5, 5, 900, 2**63 + 7], dtype=np.uint64)
    for part in (x, x[:2], x[:0], x[3:]):
        assert owners.from_planes(owners.planes(part)).tolist() == part.tolist()
    assert owners.unbundle(owners.bundle(b"", b"abc", b"d" * 1000)) == [b"", b"abc", b"d" * 1000]
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64) * np.uint64(2))
    asked = pa.concat_tables([owners.ask(0, 7, keys), owners.ask(1, 7, keys[::3]), owners.ask(2, 7, keys[:0]), owners.ask(3, 7, keys[::6])])
    got = owners.shared(spark.createDataFrame(asked.to_pandas(), owners.ASK), 2).toArrow()
    elsewhere, often = owners.told(keys, 7, got.filter(pa.compute.equal(got["block"], 0)))
    assert elsewhere.tolist() == [i % 3 == 0 for i in range(100)] and often.tolist() == [i % 6 == 0 for i in range(100)]
