import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.errors import ChecksumMismatch, CollectionExists, CollectionNotFound, DimensionMismatch, InvalidRecord, ReadWriteConflict, RecordNotFound, StorageError, WriteConflict
from tessel.functions import checksums, text
from tessel.operators import catalog, changelog
from tessel.schema import LOG_TYPE, NONEXISTENT, RECORD_TYPE, CollectionSchema, Record, SearchRequest, split_valid
from tessel.sources import codecs
from tessel.sources.collection import Store, Versions
from tessel.streaming import fold


def record(i, **more):
    return Record(f"r{i}", [float(i), 0, 0], {"x": i}, {"tag": "even" if i % 2 == 0 else "odd", "n": i, **more})


def test_life_of_a_collection(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = store.create_collection(CollectionSchema("things", 3))
    with pytest.raises(CollectionExists):
        store.create_collection(CollectionSchema("things", 3))
    with pytest.raises(CollectionNotFound):
        store.collection("none")
    assert [p.kind for p in c.insert([record(i) for i in range(6)])] == [NONEXISTENT] * 6
    base = c.max_lsn()
    (before,) = c.insert([record(2, new=True)])
    assert before.metadata == {"tag": "even", "n": 2} and c.get("r2").metadata["new"] is True
    (gone,) = c.delete(["r4"])
    assert gone.document == {"x": 4}
    assert c.delete(["r4"])[0].kind == NONEXISTENT
    with pytest.raises(RecordNotFound):
        c.get("r4")
    with pytest.raises(DimensionMismatch):
        c.insert([Record("bad", [1.0], "text")])
    with pytest.raises(WriteConflict):
        c.insert([record(2)], base_lsn=base)
    c.insert([record(7)], base_lsn=base)
    even = SearchRequest([0, 0, 0], 5, {"tag": "even"})
    found = c.search(even).collect()
    assert [r.record_id for r in found] == ["r0", "r2"] and [r.distance for r in found] == [0, 4]
    assert [r.record_id for r in c.search(SearchRequest([0, 0, 0], 5, None, {"$contains": '"x": 5'})).collect()] == ["r5"]
    assert c.search(SearchRequest([9, 0, 0], 1, metric="ip")).first().record_id == "r7"
    assert c.read("visible").count() == 0
    assert c.read(as_of=base).count() == 6
    state = {r.record_id for r in c.read().collect()}
    visible = c.flush()
    c.insert([record(9)])
    assert {r.record_id for r in c.read("visible").collect()} == state
    assert c.read("bounded", lag_bound=1).count() == len(state) and c.read("bounded", lag_bound=0).count() == len(state) + 1
    assert c.read("session", min_lsn=visible).count() == len(state) and c.read("session", min_lsn=visible + 1).count() == len(state) + 1
    c.compact()
    assert {r.record_id for r in c.read().collect()} == state | {"r9"} and c.log.count() == 2
    again = store.collection("things")
    assert again.get("r9").document == {"x": 9} and again.verify().count() == 0
    queries = spark.createDataFrame([("q", [7.2, 0.0, 0.0])], "query_id string, vector array<float>")
    assert again.search_batch(queries, 1).first().record_id == "r7"
    assert again.tsne(["r0", "r1", "r2"], 1.0).count() == 3
    store.create_collection(CollectionSchema("other", 8, "int8"))
    assert store.list_collections() == ["other", "things"]
    assert store.drop_collection("other").dim == 8 and store.drop_collection("other") is None
    store.backup(str(tmp_path / "backup"))
    assert spark.read.parquet(str(tmp_path / "backup")).count() == 1


def test_history_outlives_compaction(spark, tmp_path):
    c = Store(spark, str(tmp_path)).create_collection(CollectionSchema("things", 3))
    state = lambda **how: {r.record_id: r.document for r in c.read(**how).collect()}
    c.insert([record(1), record(2)])
    first = c.max_lsn()
    c.insert([Record("r2", [0, 0, 1.0], "changed"), record(3)])
    second, before = c.flush(), state()
    c.insert([record(4)])
    c.delete(["r1"])
    last = c.max_lsn()
    c.compact()
    assert state(as_of=second) == before and len(before) == 3 and state(as_of=last) == state() and set(state()) == {"r2", "r3", "r4"}
    with pytest.raises(StorageError):
        c.read(as_of=first)
    with pytest.raises(WriteConflict):  # r2 changed since, which only the compacted part of the log could tell
        c.insert([record(2)], base_lsn=first)
    c.insert([record(2)], base_lsn=last)
    assert state(as_of=second) == before
    with pytest.raises(InvalidRecord):
        c.insert([record(8), record(8)])
    base = c.max_lsn()
    c.insert([record(3)])
    with pytest.raises(ReadWriteConflict):
        c.insert([record(9)], base_lsn=base, reads=["r2", "r3"])
    c.insert([record(9)], base_lsn=base, reads=["r2"])
    assert {r.record_id for r in c.ids().collect()} == {"r2", "r3", "r4", "r9"}
    rows = c.log.groupBy("lsn", "record_id").agg(F.collect_set("phase").alias("phases")).collect()
    assert rows and all(set(r.phases) == {"prepare", "commit"} for r in rows if r.lsn > last)


def test_old_versions_go(spark, tmp_path):
    versions = Versions(spark, str(tmp_path), "v", "pointer")
    for i in range(13):
        versions.write(spark.range(1), i)
    assert sorted(int(p.name[2:]) for p in tmp_path.glob("v-*")) == list(range(4, 14))
    assert versions.current() == (13, 12) and versions.kept()[-1] == (4, 3)


def test_collections_shape_vectors(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create_collection(CollectionSchema("unit", 2, metric="ip", normalize=True, resize=True, pad=1.0))
    c = store.collection("unit")
    c.insert([Record("long", [30.0, 40.0, 99.0], "cut"), Record("short", [0.1], "padded"), Record("zero", [0.0, 0.0], "as it is")])
    got = {r.record_id: r.distance for r in c.search(SearchRequest([0.0, 5.0], 3)).collect()}
    assert {k: round(v, 4) for k, v in got.items()} == {"long": 0.8, "short": round(1 / 1.01**0.5, 4), "zero": 0.0}
    assert store.find("uni", max_dim=2).count() == 1 and store.damaged().count() == 0


def test_damaged_results_fail(spark, tmp_path):
    c = Store(spark, str(tmp_path)).create_collection(CollectionSchema("things", 3))
    c.insert([record(i) for i in range(3)])
    bad = spark.createDataFrame([("r7", "RECORD", [9.0, 0.0, 0.0], "text", True, None, "wrong", "sha256")], RECORD_TYPE)
    c.write(bad)
    assert c.search(SearchRequest([0, 0, 0], 3)).count() == 3
    with pytest.raises(Exception, match="checksum mismatch: r7"):
        c.search(SearchRequest([9, 0, 0], 1)).collect()


def test_a_write_reads_the_keys_of_its_batch(spark, tmp_path):
    c = Store(spark, str(tmp_path)).create_collection(CollectionSchema("things", 3))
    c.insert([record(i) for i in range(4)])
    c.flush()
    plan = c.read(keys=spark.createDataFrame([("r1",)], "record_id string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 2 and "RepartitionByExpression" not in plan and "Sort" not in plan


def test_requests_are_checked():
    request = SearchRequest([1, 2], 3)
    request.validate(2)
    with pytest.raises(DimensionMismatch):
        request.validate(3)
    request.where = {"a": 1}
    with pytest.raises(ChecksumMismatch):
        request.validate()
    with pytest.raises(InvalidRecord):
        SearchRequest([1], 0)
    with pytest.raises(InvalidRecord):
        Record("x", [1.0])
    with pytest.raises(InvalidRecord):
        Record("x", [1.0], metadata={"a": {"b": 1}})
    with pytest.raises(InvalidRecord):
        Record("x", [1.0], kind="TOMBSTONE")


def test_bad_rows_are_split(spark):
    rows = [Record("a", [1.0, 2.0], "t").row(), ("b", "RECORD", [1.0], "t", True, None, "", "sha256"), ("c", "RECORD", None, "t", True, None, "", "sha256"), ("d", "RECORD", [1.0, 2.0], None, None, None, "", "sha256"),
            ("e", "RECORD", [1.0, 2.0], None, None, '{"a": {"b": 1}}', "", "sha256"), ("f", "TOMBSTONE", None, "t", True, None, "", "sha256"), Record.tombstone("g").row()]
    good, bad = split_valid(spark.createDataFrame(rows, RECORD_TYPE), 2)
    assert {r.record_id for r in good.collect()} == {"a", "g"}
    assert {r.record_id: r.problem for r in bad.collect()} == {"b": "wrong dimension", "c": "no vector", "d": "neither document nor metadata", "e": "nested metadata", "f": "content without a record"}


def test_codecs(spark):
    for r in (Record("ü", [1.5, -2], {"x": 1, "y": "é"}, {"k": [1, "a"]}), Record("b", [0.0], "plain"), Record("c", [1.0], None, {})):
        data = codecs.to_bytes(r)
        back = codecs.from_bytes(data + b"tail")
        assert (back.record_id, back.document, back.metadata, back.checksum) == (r.record_id, r.document, r.metadata, r.checksum) and codecs.size_of(data) == len(data)
        assert codecs.from_dict(codecs.to_dict(r)).checksum == r.checksum
        with pytest.raises((ChecksumMismatch, InvalidRecord)):
            codecs.from_bytes(data[:25] + bytes([data[25] ^ 1]) + data[26:])
    with pytest.raises(InvalidRecord):
        codecs.from_bytes(b"XXXX" + data[4:])
    rows = spark.createDataFrame([record(i).row() for i in range(3)], RECORD_TYPE)
    back = rows.select(codecs.decoded(codecs.encoded(F.struct(*RECORD_TYPE.names))).alias("r")).select("r.*")
    assert sorted(back.collect()) == sorted(rows.collect())


def test_checksums(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,)], "x string")
    for name in ("crc32", "MD5", "sha1", "sha256", "sha512", "blake2b"):
        got = [r[0] for r in rows.select(checksums.column_digest(F.col("x"), name)).collect()]
        assert got == [checksums.digest(b"a", name), checksums.digest(b"", name), None]
    assert checksums.digest(b"a", "crc32") == "e8b7be43" and checksums.digest(b"a", lambda b: "mine") == "mine"
    with pytest.raises(InvalidRecord):
        checksums.digest(b"", "nope")
    parts = b"RECORD" + b"r" + b'{"a": "\\u00e9"}' + np.array([1], "<f4").tobytes() + b"null"
    assert Record("r", [1.0], {"a": "é"}).checksum == hashlib.sha256(parts).hexdigest()
    wire = checksums.array_to_wire(np.array([[1.0, 2.0]]))
    assert checksums.array_from_wire(wire).tolist() == [[1.0, 2.0]]
    one = spark.createDataFrame([(wire["b64"], wire["dtype"], wire["shape"])], "b64 string, dtype string, shape array<int>")
    assert one.select(checksums.wire_vector(F.struct("b64", "dtype", "shape"))).first()[0] == [1.0, 2.0]


def test_text_tables(spark):
    docs = spark.createDataFrame([("a", '{"name": "John", "age": 30, "ok": true, "tags": ["x", "y", 2], "m": {"level": "s", "n": null}}'), ("b", "plain text, Plain_1"), ("c", "[1]"), ("d", None)], "id string, t string")
    got = {(r.path, r.value) for r in text.field_rows(docs, "id", "t").collect()}
    assert got == {("name", "John"), ("age", "30"), ("ok", "True"), ("tags", "x"), ("tags", "y"), ("tags", "2"), ("m", '{"level":"s","n":null}'), ("m.level", "s"), ("m.n", "None")}
    assert {r.term for r in text.term_rows(docs.where("id = 'b'"), "id", "t").collect()} == {"plain", "text", "plain_1"}
    assert text.postings(docs, "id", "t").where("term = 'plain'").first().ids == ["b"]


def log(spark, *rows):
    full = [(lsn, phase, i, "TOMBSTONE" if gone else "RECORD", None, str(lsn), True, None, None, None) for lsn, phase, i, gone in rows]
    return spark.createDataFrame(full, LOG_TYPE)


def test_log_rules(spark):
    entries = log(spark, (1, "prepare", "a", False), (2, "prepare", "b", False), (3, "prepare", "a", True), (4, "prepare", "c", False), (5, "prepare", "a", False), (0, "commit", "a", False), (0, "commit", "b", False))
    assert {r.lsn for r in changelog.committed(entries).collect()} == {1, 2, 3, 5}
    assert [r.lsn for r in changelog.replay(entries, 1).collect()] == [2, 3, 5]
    assert {r.record_id for r in changelog.replayed(entries, 2).collect()} == {"a"}
    left = {(r.lsn, r.phase, r.record_id) for r in changelog.compacted(entries, 2).collect()}
    assert left == {(3, "prepare", "a"), (4, "prepare", "c"), (5, "prepare", "a"), (0, "commit", "a")}
    live = changelog.fold(entries.where("phase = 'prepare'"), F.col("kind") == "TOMBSTONE", as_of=4)
    assert {r.record_id for r in live.collect()} == {"b", "c"}
    batch = changelog.numbered(spark.range(50).repartition(7), 10, ["id"]).orderBy("id").collect()
    assert all(x.lsn < y.lsn for x, y in zip(batch, batch[1:], strict=False)) and batch[0].lsn > 10


def test_conflicts(spark):
    rows = [(1, "r", "write", 0, 10), (2, "r", "write", 5, None), (3, "s", "read", 0, None), (4, "s", "write", 1, 2), (5, "t", "write", 0, None)]
    accesses = spark.createDataFrame(rows, "version int, record_id string, access string, created_at int, committed_at int")
    assert {tuple(r) for r in changelog.conflicts(accesses).collect()} == {(2, "r", "write-write", 1, 1), (3, "s", "read-write", 1, 4)}


def test_catalog(spark):
    rows = spark.createDataFrame([("a_1", 128, "float32"), ("b", 256, "float64"), ("C", 512, "int8")], "name string, dim int, vector_type string")
    rows = rows.withColumn("checksum", F.sha2(F.concat("name", F.col("dim").cast("string"), "vector_type"), 256))
    assert [r.name for r in catalog.search(rows, "c").collect()] == ["C"]
    assert [r.name for r in catalog.search(rows, "", "", 200, 600).collect()] == ["C", "b"]
    total = catalog.statistics(rows).where("total = 1").first()
    assert (total.n, total.min_dim, total.max_dim, round(total.avg_dim, 2)) == (3, 128, 512, 298.67)
    assert catalog.damaged(rows).count() == 0 and catalog.damaged(rows.withColumn("dim", F.col("dim") + 1)).count() == 3


def test_stream_is_batch(spark, tmp_path):
    schema = "lsn long, record_id string, v string"
    rows = [(i, f"k{i % 5}", str(i)) for i in range(40)]
    target = str(tmp_path / "log")
    spark.createDataFrame(rows[:25], schema).repartition(3).write.parquet(target)
    out, kind = str(tmp_path / "out"), spark.createDataFrame([], schema).schema
    for part in (None, rows[25:], rows[:5]):  # the last one is delivered again
        if part:
            spark.createDataFrame(part, schema).write.mode("append").parquet(target)
        fold.start(spark, target, kind, out, files_per_batch=1).awaitTermination()
    assert sorted(fold.state(spark, out, kind).collect()) == sorted(changelog.latest(spark.createDataFrame(rows, schema)).collect())


def test_command_line(spark, tmp_path):
    from tessel.__main__ import command

    store = Store(spark, str(tmp_path))
    assert command(store, ["create", "c", "2"]) == ["c"] and command(store, ["list"]) == ["c"]
    assert command(store, ["insert", "c", "a", "[1, 0]", "plain text", '{"n": 1}'])[0]["type"] == NONEXISTENT
    command(store, ["insert", "c", "b", "0,1", '{"x": 1}'])
    assert [r["record_id"] for r in command(store, ["search", "c", "1,0", "5", '{"n": 1}'])] == ["a"]
    assert command(store, ["get", "c", "b"])[0]["original_data"] == {"x": 1}
    assert command(store, ["delete", "c", "b"])[0]["vector"] == [0, 1]
    with pytest.raises(InvalidRecord):
        command(store, ["nope"])
    store.close()
    assert store.collection("c").read("visible").count() == 1


def test_equality_and_figures(spark):
    from tessel.operators.metrics import observed

    assert record(1) == record(1) != record(2) and len({record(1), record(1)}) == 1
    df, seen = observed(spark.range(7), top=F.max("id"))
    df.collect()
    assert seen.get == {"rows": 7, "top": 6}


def test_term_and_field_tables_follow_changes(spark, tmp_path):
    c = Store(spark, str(tmp_path)).create_collection(CollectionSchema("things", 3))
    say = lambda i, document: Record(i, [1.0, 0, 0], document)
    terms = lambda: {(r.term, r.record_id) for r in c.terms().collect()}
    fields = lambda: {(r.path, r.value, r.record_id) for r in c.fields().collect()}
    c.insert([say("a", "Red red fox"), say("b", "a fox"), say("c", {"x": {"y": [1, True]}})])
    plain = terms(), fields()
    assert plain[0] == {("red", "a"), ("fox", "a"), ("a", "b"), ("fox", "b")}
    assert {f for f in plain[1] if f[0] == "x.y"} == {("x.y", "1", "c"), ("x.y", "True", "c")}
    c.index()
    assert (terms(), fields()) == plain
    c.insert([say("b", {"z": 2}), say("c", "now text"), say("d", "fox")])
    c.delete(["a"])
    after = {("now", "c"), ("text", "c"), ("fox", "d")}, {("z", "2", "b")}
    assert (terms(), fields()) == after
    c.flush()
    assert (terms(), fields()) == after and c.derived["terms"].current()[1] == c.max_lsn()
    c.compact()
    c.delete(["d"])
    assert terms() == after[0] - {("fox", "d")} and fields() == after[1]


def test_tables_older_than_the_log_are_not_used(spark, tmp_path):
    c = Store(spark, str(tmp_path)).create_collection(CollectionSchema("things", 3))
    c.insert([Record("a", [1.0, 0, 0], "old")])
    c.index()
    c.insert([Record("a", [1.0, 0, 0], "new")])
    c.snapshots.write(c.read(), c.max_lsn())
    c.compact()
    assert [r.term for r in c.terms().collect()] == ["new"]


def test_snapshots_are_laid_out_by_id(spark, tmp_path):
    c = Store(spark, str(tmp_path)).create_collection(CollectionSchema("things", 3))
    c.write(spark.range(2000).selectExpr("concat('r', lpad(7919 * id % 2000, 5, '0')) record_id", "'RECORD' kind", "array(1f, 2f, 3f) vector", "'t' document", "true document_is_text", "string(null) metadata", "string(null) checksum", "string(null) checksum_algorithm"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or small ranges would be put together
    try:
        c.flush()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    ranges = sorted((r.least, r.most) for r in c.read("visible").groupBy(F.input_file_name()).agg(F.min("record_id").alias("least"), F.max("record_id").alias("most")).collect())
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_damaged_logs(spark, tmp_path):
    c = Store(spark, str(tmp_path)).create_collection(CollectionSchema("things", 3))
    assert c.checked().unreadable() == []
    c.insert([record(1)])
    c.insert([record(2)])
    figures = c.log_statistics().first()
    assert (figures.n_entries, figures.needs_compaction) == (4, False) and figures.n_files >= 2 and figures.n_bytes > 0
    assert c.unreadable() == []
    first = min(tmp_path.glob("things/log-0/*.parquet"), key=lambda p: p.stat().st_mtime)
    first.write_bytes(b"PAR1 damaged")
    for crc in tmp_path.glob("things/log-0/.*.crc"):
        crc.unlink()
    assert c.unreadable() == [first.name]
    with pytest.raises(StorageError, match=first.name):
        c.checked()
    assert c.repair() == [first.name] and c.checked().repair() == []
    assert [r.record_id for r in c.read().collect()] == ["r2"]


def test_strategies_and_interfaces(spark, tmp_path):
    from tessel.operators import strategies
    from tessel.sources import interfaces

    store = Store(spark, str(tmp_path))
    c = store.create_collection(CollectionSchema("things", 3))
    assert isinstance(store, interfaces.Collections) and all(isinstance(c, x) for x in (interfaces.Changes, interfaces.Records, interfaces.Searchable))
    c.insert([record(i) for i in range(6)])
    near = SearchRequest([2.2, 0, 0], 2)
    exact, approximate = ([(r.record_id, r["rank"], r.distance) for r in c.search(near, strategy=s).collect()] for s in ("exact", "approximate"))
    assert exact == approximate and [x[0] for x in exact] == ["r2", "r3"]
    with pytest.raises(InvalidRecord):
        c.search(near, strategy="none")

    @strategies.register("first")
    def first(rows, query, k, metric, key, vector):
        return strategies.strategy("exact")(rows, query, 1, metric, key, vector)

    try:
        assert c.search(near, strategy="first").count() == 1
    finally:
        del strategies.STRATEGIES["first"]


def test_tenants(spark, tmp_path):
    from tessel.sources import tenants

    rows = spark.range(400).selectExpr("id", "if(id % 3 = 0, 'big', concat('t', id % 7)) as tenant")
    tenants.write(rows, str(tmp_path / "t"), "tenant", 8, files=2)
    got = tenants.read(spark, str(tmp_path / "t"), "tenant", "big", 8)
    assert {r.id for r in got.collect()} == set(range(0, 400, 3)) and got.columns == ["id", "tenant"]
    assert len(got.inputFiles()) <= len(spark.read.parquet(str(tmp_path / "t")).inputFiles())
    assert "PartitionFilters: [isnotnull(tenant_slot" in got._jdf.queryExecution().executedPlan().toString()
    assert tenants.read(spark, str(tmp_path / "t"), "tenant", "nobody", 8).isEmpty()


def test_numbers_follow_the_order(spark):
    rows = changelog.numbered(spark.range(500).selectExpr("7 * id % 500 as key"), 40, ["key"]).orderBy("lsn").collect()
    assert [r.key for r in rows] == list(range(500)) and rows[0].lsn > 40 and len({r.lsn for r in rows}) == 500


def test_meter(spark):
    from tessel.operators.metrics import Meter

    meter = Meter((0.5, 2))
    for s in (0.1, 0.5, 1, 9):
        meter.add("search", s, s > 5)
    with pytest.raises(ValueError), meter.timed("get"):
        raise ValueError
    rows = meter.table(spark).where("name = 'search'").collect()
    assert [(r.at_most, r.n_at_most) for r in rows] == [(0.5, 2), (2.0, 3), (None, 4)] and (rows[0].n, rows[0].n_failed) == (4, 1)
    assert meter.table(spark).where("name = 'get'").first().n_failed == 1
