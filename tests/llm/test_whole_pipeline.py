"""The pipeline against brute force on small tables."""

import itertools

import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, brute_bytes, corpus, fold, learn_ties, order, ranked

import corpus_pipeline
from tessel.llm import suffix_dedup


def test_each_stage_runs_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "a text", 6) for i in range(8)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    ran, read = spark.sparkContext.accumulator(0), []

    def counted(spark, docs, sf_dir):
        def run(batches):
            for b in batches:
                ran.add(b.num_rows)
                yield b

        return docs.mapInArrow(run, docs.schema)

    def scans_twice(spark, docs, sf_dir):
        read.extend(docs.inputFiles())
        return docs.join(docs.select(F.col("doc_id") + 1).toDF("doc_id"), "doc_id")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("counted", counted), ("scans twice", scans_twice)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 7 and out.count() == 7 and ran.value == 8
    assert read and all(spark.conf.get("spark.checkpoint.dir") in f for f in read + list(out.inputFiles()))


@pytest.mark.parametrize("length", [100, 20])
def test_shortened_texts(spark, length):
    rows = spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumn("other", F.struct("block"))
    learn_ties(rows)
    expected = []
    for i, b, gone in brute_bytes(length):
        kept, at = "", 0
        for c in b.decode():
            size = len(c.encode())
            kept += "" if any(gone[at : at + size]) else c
            at += size
        expected.append((i, kept))
    got = [(r.doc_id, r.text) for r in suffix_dedup.shortened(rows, length).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_whole_run(spark, tmp_path, monkeypatch):
    """run() on a fixture: what the classifier keeps, then each stage's rows by brute force."""
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    rows = corpus()
    item = " ".join(fold(rows[0][1])[20:60])
    rows += [(500, item + " and a little more", "b", 1, "s"), (501, rows[2][1] + " " + " ".join(item.split()[:5]), "b", 1, "s")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t, *_ in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i != 70)) for i, *_ in rows if i is not None], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(corpus_pipeline, "scratch", lambda spark: str(tmp_path / "run"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stage = lambda k: [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "run" / str(k))).collect()]
    same = lambda a, b: sorted(a, key=str) == sorted(b, key=str)

    kept = stage(0)
    assert len(kept) > 20 and set(kept) <= {(i, t) for i, t, *_ in rows}
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := fold(t)) else set() for _, t in kept]
    group = list(range(len(kept)))
    for _ in kept:
        for a, b in itertools.combinations(range(len(kept)), 2):
            if sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    members = {}
    for k, g in enumerate(group):
        members.setdefault(g, []).append(k)
    near = stage(1)
    assert len(near) == len(members) < len(kept)
    texts = {}
    for i, t in kept:
        texts.setdefault(i, []).append(t)
    least = [min((order(kept[k][0]) for k in m)) for m in members.values()]
    assert sorted(order(i) for i, _ in near) == sorted(least) and all(t in texts[i] for i, t in near)

    learn_ties(spark.createDataFrame(near, "doc_id long, text string"))
    seen, shorter = set(), []
    for i, t in sorted(near, key=lambda r: ranked(*r)):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(b[k : k + 100])
        text, at = "", 0
        for c in t or "":
            size = len(c.encode())
            text += "" if any(gone[at : at + size]) else c
            at += size
        shorter.append((i, text))
    assert same(stage(2), shorter)

    words, clean = item.split(), []
    windows = {tuple(words[k : k + 13]) for k in range(len(words) - 12)}
    for i, t in shorter:
        w, hit = fold(t), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in windows:
                hit.update(range(k, k + 13))
        if not hit or 20 * len(hit) < len(w):
            clean.append((i, t))
    assert same(stage(3), clean) and len(clean) < len(shorter)
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    assert same([(r.doc_id, r.ids, r.decoded) for r in got], [(i, ",".join(map(str, ids := lib.encode(t))), lib.decode(ids)) for i, t in clean])
