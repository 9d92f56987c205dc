"""The engine's registered queries over the driver's tables, each with the DuckDB SQL of the same rows where SQL can express it."""

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StorageError, WriteConflict
from .functions import checksums, text, vectors
from .operators import catalog, changelog, projection, search
from .plans import filters
from .schema import RECORD, RECORD_TYPE, TOMBSTONE, CollectionSchema
from .sources import codecs, tenants
from .sources.collection import Store
from .streaming import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or, with a local master only, a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/scratch-{uuid.uuid4()}"
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise StorageError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="scratch-")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the document and labels of the same number."""
    e, d, q = (table(spark, sf_dir, t) for t in ("embeddings", "documents", "labels"))
    d = d.withColumnRenamed("doc_id", "vec_id")
    q = q.withColumnRenamed("doc_id", "vec_id").dropDuplicates(["vec_id"])
    return e.join(d, "vec_id", "left").join(q, "vec_id", "left")


RECORDS = "embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN labels l ON e.vec_id = l.doc_id"
Q = "WITH q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0) "
L2 = "round(list_sum(list_transform(list_zip(embedding::DOUBLE[], qe), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"
IP = "round(list_sum(list_transform(list_zip(embedding::DOUBLE[], qe), lambda z: z[1] * z[2])), 6)"
COSINE = "round(list_cosine_similarity(embedding::DOUBLE[], qe), 6)"


def top(rows: DataFrame, query_vector: list[float], k: int = 10, metric: str = "l2", where=None) -> DataFrame:
    found = search.knn(rows, query_vector, k, metric, "vec_id", "embedding", where)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


def top_sql(source: str = "embeddings", measure: str = L2, order: str = "", where: str = "true", k: int = 10) -> str:
    return f"{Q} SELECT e.vec_id AS vec_id, {measure} AS distance FROM {source}, q WHERE {where} ORDER BY distance {order}, e.vec_id LIMIT {k}"


for _metric, _measure, _order in (("l2", L2, ""), ("ip", IP, "DESC"), ("cosine", COSINE, "DESC")):
    query(top_sql("embeddings e", _measure, _order), f"knn_{_metric}")(lambda spark, d, metric=_metric: top(table(spark, d, "embeddings"), first_vector(spark, d), metric=metric))


def _filtered(where: dict | None, document: dict | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir)
        condition = filters.where(where, rows.schema) & filters.where_document(document, F.col("text"))
        return top(rows, first_vector(spark, sf_dir), where=condition)

    return run


FLAGSHIP = ({"lang": ["en"]}, {"$contains": "the"})
_WITH_SQL = {
    "knn_filtered_eq": (({"lang": "fr"}, None), "lang = 'fr'"),
    "knn_filtered_in": (({"source": {"$in": ["src1", "src2"]}}, None), "source IN ('src1', 'src2')"),
    "knn_filtered_range": (({"n_chars": {"$gte": 1000, "$lt": 3000}}, None), "n_chars >= 1000 AND n_chars < 3000"),
    "knn_filtered_doc": ((None, {"$contains": "tion"}), "contains(text, 'tion')"),
    "knn_filtered_both": (FLAGSHIP, "lang IN ('en') AND contains(text, 'the')"),
}
for _name, (_args, _sql) in _WITH_SQL.items():
    query(top_sql(RECORDS, where=_sql), _name)(_filtered(*_args))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered nearest-neighbour search: metadata filter, document filter, exact top-k."""
    return _filtered(*FLAGSHIP)(spark, sf_dir)


@query(top_sql("embeddings e", where="vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def knn_semi(spark, d):
    ids = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return top(search.allowed(table(spark, d, "embeddings"), ids, "vec_id"), first_vector(spark, d))


@query(f"SELECT vec_id, distance, lang, n_chars FROM ({top_sql('embeddings e')}) t JOIN documents ON doc_id = vec_id")
def knn_hydrate(spark, d):
    found = top(table(spark, d, "embeddings"), first_vector(spark, d))
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "vec_id")
    return search.hydrate(found, docs, "vec_id").select("vec_id", "distance", "lang", "n_chars")


@query(top_sql("embeddings e", where=f"{L2} <= 1.9", k=20))
def knn_within(spark, d):
    found = search.knn(table(spark, d, "embeddings"), first_vector(spark, d), 20, "l2", "vec_id", "embedding", within=F.round("distance", 6) <= 1.9)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query(top_sql("embeddings e"))
def knn_sharded(spark, d):
    """Four shards answer their ten nearest each; the merge takes ten of these."""
    rows, q = table(spark, d, "embeddings"), first_vector(spark, d)
    shards = [search.knn(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(4)) == i), q, 10, "l2", "vec_id", "embedding") for i in range(4)]
    return search.merge_shards(shards, 10, key="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


BATCH = """
    WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {m} AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 10 = 0) a, embeddings b)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance {o}, vec_id))::INTEGER AS rank, vec_id, distance FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance {o}, vec_id) <= 5"""
for _metric, _measure, _order in (("l2", L2, ""), ("ip", IP, "DESC"), ("cosine", COSINE, "DESC")):

    @query(BATCH.format(m=_measure, o=_order), "knn_batch" if _metric == "l2" else f"knn_batch_{_metric}")
    def _batch(spark, d, metric=_metric):
        rows = table(spark, d, "embeddings")
        queries = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        return search.knn_batch(rows, queries, 5, metric, "vec_id", "embedding", "query_id", "embedding").withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / n) * (x / n)))), 6) AS norm, round(embedding[1]::DOUBLE / n, 6) AS x1 FROM (SELECT *, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)")
def normalize(spark, d):
    v = vectors.normalized(F.col("embedding"))
    return table(spark, d, "embeddings").withColumn("v", v).select("vec_id", F.round(vectors.norm(F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("x1"))


@query("SELECT vec_id, 80 AS size, round(embedding[64]::DOUBLE, 6) AS last, 0.5::DOUBLE AS pad, 16 AS cut_size, round(embedding[16]::DOUBLE, 6) AS cut_last FROM embeddings")
def pad_truncate(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", vectors.fitted(F.col("embedding"), 80, 0.5).alias("long"), vectors.fitted(F.col("embedding"), 16).alias("short"))
    return rows.select("vec_id", F.size("long").alias("size"), F.round(F.col("long")[63], 6).alias("last"), F.col("long")[79].alias("pad"), F.size("short").alias("cut_size"), F.round(F.col("short")[15], 6).alias("cut_last"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], qe), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM embeddings, (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0)")
def euclidean(spark, d):
    q = vectors.doubles(first_vector(spark, d))
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.euclidean(vectors.doubles(F.col("embedding")), q), 6).alias("distance"))


@query("SELECT vec_id, embedding[1] AS x1, len(embedding) AS size FROM embeddings")
def vector_parse(spark, d):
    written = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", "), F.lit("]"))
    parsed = vectors.parsed(written)
    return table(spark, d, "embeddings").select("vec_id", parsed[0].alias("x1"), F.size(parsed).cast("long").alias("size"))


# Metadata filters over typed columns, and over JSON as VARIANT.
_WHERE = {
    "where_eq": ({"lang": "de"}, "lang = 'de'"),
    "where_in": ({"lang": {"$in": ["de", "es"]}}, "lang IN ('de', 'es')"),
    "where_list": ({"source": ["src3", "src4"]}, "source IN ('src3', 'src4')"),
    "where_in_empty": ({"lang": {"$in": []}}, "false"),
    "where_gte": ({"n_chars": {"$gte": 2000}}, "n_chars >= 2000"),
    "where_gt": ({"n_chars": {"$gt": 2000}}, "n_chars > 2000"),
    "where_lte": ({"n_chars": {"$lte": 2000}}, "n_chars <= 2000"),
    "where_lt": ({"n_chars": {"$lt": 2000}}, "n_chars < 2000"),
    "where_and": ({"lang": "en", "n_chars": {"$gte": 500, "$lte": 4000}, "quality": 1}, "lang = 'en' AND n_chars BETWEEN 500 AND 4000 AND quality = 1"),
    "where_in_or_range": ({"n_chars": {"$in": [100, 200], "$gt": 5000}}, "n_chars IN (100, 200) OR n_chars > 5000"),
    "where_unknown": ({"lang": {"$ne": "en"}}, "false"),
    "where_missing": ({"author": "x"}, "false"),
    "where_null": ({"quality": None}, "quality IS NULL"),
    "where_bool_number": ({"quality": True}, "quality = 1"),
    "where_none": ({}, "true"),
}
for _name, (_filter, _sql) in _WHERE.items():

    @query(f"SELECT vec_id FROM {RECORDS} WHERE {_sql}", _name)
    def _where(spark, d, f=_filter):
        rows = records(spark, d)
        return rows.where(filters.where(f, rows.schema)).select("vec_id")


_VARIANT = {
    "where_variant_eq": ({"k": 50}, "(props->>'k')::INT = 50"),
    "where_variant_text": ({"k": "50"}, "false"),
    "where_variant_range": ({"k": {"$gte": 20, "$lt": 30}}, "(props->>'k')::INT >= 20 AND (props->>'k')::INT < 30"),
    "where_variant_in_or_range": ({"k": {"$in": [1, 2.0], "$gt": 95}}, "(props->>'k')::INT IN (1, 2) OR (props->>'k')::INT > 95"),
}
for _name, (_filter, _sql) in _VARIANT.items():

    @query(f"SELECT event_id FROM events WHERE {_sql}", _name)
    def _variant(spark, d, f=_filter):
        return table(spark, d, "events").where(filters.where(f, metadata=F.parse_json("props"))).select("event_id")


@query("SELECT l_orderkey FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags, list(l_quantity) AS amounts FROM lineitem GROUP BY 1) WHERE list_contains(flags, 'R') AND len(list_filter(amounts, lambda x: x > 10 AND x < 12)) > 0")
def where_multivalue(spark, d):
    """A list matches if one of its values does; both bounds have to hold for the same value."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.collect_list("l_quantity").alias("amounts"))
    return rows.where(filters.where({"flags": "R", "amounts": {"$gt": 10, "$lt": 12}}, rows.schema)).select("l_orderkey")


_DOCUMENT = {
    "doc_contains": ({"$contains": "tion"}, "contains(text, 'tion')"),
    "doc_not_contains": ({"$not_contains": "the"}, "NOT contains(text, 'the')"),
    "doc_and": ({"$and": [{"$contains": "the"}, {"$not_contains": "tion"}]}, "contains(text, 'the') AND NOT contains(text, 'tion')"),
    "doc_or": ({"$or": [{"$contains": "euse"}, {"$contains": "schen"}]}, "contains(text, 'euse') OR contains(text, 'schen')"),
    "doc_implicit": ({"$contains": "the", "$not_contains": "nd"}, "contains(text, 'the') AND NOT contains(text, 'nd')"),
    "doc_empty": ({"$contains": ""}, "true"),
    "doc_or_empty": ({"$or": []}, "false"),
    "doc_unknown": ({"$regex": "x"}, "false"),
}
for _name, (_filter, _sql) in _DOCUMENT.items():

    @query(f"SELECT doc_id FROM documents WHERE text <> '' AND ({_sql})", _name)
    def _document(spark, d, f=_filter):
        return table(spark, d, "documents").where(filters.where_document(f, F.col("text"))).select("doc_id")


@query(r"SELECT term, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS term FROM documents) GROUP BY term")
def term_postings(spark, d):
    return text.term_counts(table(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS term, doc_id FROM documents")
def term_pairs(spark, d):
    return text.term_rows(table(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT term, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS term FROM documents) GROUP BY term")
def posting_lists(spark, d):
    return text.postings(table(spark, d, "documents"), "doc_id", "text").select("term", F.array_join("ids", ",").alias("ids"))


NESTED = """SELECT path, value, event_id FROM (SELECT 'a' AS path, '{"b":{"c":' || (props->>'k') || ',"d":["x","y"]}}' AS value, event_id FROM events
    UNION ALL SELECT 'a.b', '{"c":' || (props->>'k') || ',"d":["x","y"]}', event_id FROM events UNION ALL SELECT 'a.b.c', props->>'k', event_id FROM events
    UNION ALL SELECT 'a.b.d', unnest(['x', 'y']), event_id FROM events)"""


@query(NESTED)
def field_paths_nested(spark, d):
    deep = F.concat(F.lit('{"a": {"b": {"c": '), F.get_json_object("props", "$.k"), F.lit(', "d": ["x", "y"]}}}'))
    return text.field_rows(table(spark, d, "events").select("event_id", deep.alias("props")), "event_id", "props")


@query("SELECT 'k' AS path, props->>'k' AS value, event_id FROM events")
def field_paths(spark, d):
    return text.field_rows(table(spark, d, "events"), "event_id", "props")


FALSY = "CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '{}' WHEN 3 THEN '[]' WHEN 4 THEN '0' ELSE text END"


@query(f"SELECT doc_id FROM (SELECT doc_id, {FALSY} AS t FROM documents) WHERE doc_id % 8 > 4 AND t <> '' AND NOT contains(t, 'tion')")
def doc_falsy(spark, d):
    """Documents that are empty, as text or as JSON, match no filter."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(FALSY).alias("t"), (F.col("doc_id") % 8 > 4).alias("is_text"))
    return rows.where(filters.where_document({"$not_contains": "tion"}, F.col("t"), F.col("is_text"))).select("doc_id")


def _record_rows(spark, d):
    """Embeddings with their documents as rows of records."""
    rows = records(spark, d).select(F.col("vec_id").cast("string").alias("record_id"), F.lit(RECORD).alias("kind"), F.col("embedding").alias("vector"), F.coalesce("text", F.lit("none")).alias("document"), F.lit(True).alias("document_is_text"))
    rows = rows.select("*", F.to_json(F.struct(F.length("document").alias("n"))).alias("metadata"), F.lit(None).cast("string").alias("checksum"), F.lit("sha256").alias("checksum_algorithm"))
    return rows.withColumn("checksum", checksums.record_digest(F.struct(*RECORD_TYPE.names)))


@query(f"SELECT e.vec_id::VARCHAR AS record_id, embedding[64] AS last, sha256(coalesce(text, 'none')) AS document, true AS sound FROM {RECORDS}")
def codec_round_trip(spark, d):
    """Records as bytes and back; decoding fails where a checksum is wrong."""
    rows = _record_rows(spark, d)
    back = rows.select(codecs.decoded(codecs.encoded(F.struct(*RECORD_TYPE.names))).alias("r"), "checksum")
    return back.select("r.record_id", F.element_at("r.vector", -1).alias("last"), F.sha2("r.document", 256).alias("document"), (F.col("r.checksum") == F.col("checksum")).alias("sound"))


@query("SELECT vec_id, embedding[1] AS x1, embedding[64] AS x64, 64 AS size FROM embeddings")
def wire_vectors(spark, d):
    """Vectors as base64 text and back."""
    rows = table(spark, d, "embeddings").select("vec_id", checksums.vector_wire(F.col("embedding")).alias("wire"))
    back = rows.select("vec_id", checksums.wire_vector(F.col("wire")).alias("v"))
    return back.select("vec_id", F.col("v")[0].alias("x1"), F.col("v")[63].alias("x64"), F.size("v").alias("size"))


def _history(spark, d):
    """A collection of all customers: written, a third changed, a snapshot, a fifth deleted, a compaction; and the lsns after each write."""
    c = Store(spark, scratch(spark)).create_collection(CollectionSchema("customers", 1))
    full = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), F.lit(RECORD).alias("kind"), F.array(F.col("c_acctbal").cast("float")).alias("vector"), F.col("c_name").alias("document"), F.lit(True).alias("document_is_text"))
    full = full.select("*", *(F.lit(None).cast("string").alias(k) for k in ("metadata", "checksum", "checksum_algorithm")))
    c.write(full)
    lsns = [c.max_lsn()]
    c.write(full.where("record_id % 3 = 0").withColumn("document", F.lit("changed")))
    lsns.append(c.flush())
    gone = full.where("record_id % 5 = 0").select("record_id", F.lit(TOMBSTONE).alias("kind"))
    c.write(gone.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD_TYPE.fields[2:])))
    lsns.append(c.max_lsn())
    c.compact()
    return c, lsns


@query("""SELECT 'snapshot' AS state, c_custkey::VARCHAR AS record_id, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS document FROM customer
          UNION ALL SELECT 'newest', c_custkey::VARCHAR, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END FROM customer WHERE c_custkey % 5 <> 0""")
def as_of_compacted(spark, d):
    """What a collection was at an lsn is still to be had after a compaction, from the newest snapshot before it."""
    c, (_, second, last) = _history(spark, d)
    state = lambda name, lsn: c.read(as_of=lsn).select(F.lit(name).alias("state"), "record_id", "document")
    return state("snapshot", second).unionByName(state("newest", last))


@query("SELECT * FROM (VALUES ('after the first write', true), ('after the second', true), ('after the third', false)) t(base, refused)")
def conflict_compacted(spark, d):
    """A writer whose base is older than the compaction, or whose record changed since, is refused."""
    c, lsns = _history(spark, d)
    one = c.read().where("record_id = '1'").withColumn("document", F.lit("mine"))
    tombstone = one.select("record_id", F.lit(TOMBSTONE).alias("kind"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD_TYPE.fields[2:])).withColumn("record_id", F.lit("5"))
    out = []
    for name, lsn in zip(("after the first write", "after the second", "after the third"), lsns, strict=True):
        try:
            c.write(tombstone if lsn == lsns[1] else one, lsn)
            out.append((name, False))
        except WriteConflict:
            out.append((name, True))
    return spark.createDataFrame(out, "base string, refused boolean")


KEPT = r"""SELECT DISTINCT unnest(regexp_extract_all(lower(CASE WHEN doc_id % 3 = 0 THEN source || ' changed' ELSE coalesce(text, '') END), '[\p{L}\p{N}\p{M}_]+')) AS term, doc_id::VARCHAR AS record_id
    FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 = 0"""


@query(KEPT)
def terms_kept(spark, d):
    """A collection's term table, written before a fifth of its documents was deleted and a third, deleted ones among them, written anew."""
    c = Store(spark, scratch(spark)).create_collection(CollectionSchema("texts", 1))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.coalesce("text", F.lit("")).alias("document"), "source")
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD_TYPE.fields}
    own = {"kind": F.lit(RECORD).alias("kind"), "vector": F.array(F.lit(0.0).cast("float")).alias("vector"), "document_is_text": F.lit(True).alias("document_is_text")}
    shape = lambda df, own: df.select(*(n if n in ("record_id", "document") and n not in own else own.get(n, blank[n]) for n in RECORD_TYPE.names))
    c.write(shape(rows, own))
    c.index()
    c.write(shape(rows.where("record_id % 5 = 0"), {"kind": F.lit(TOMBSTONE).alias("kind"), "document": blank["document"]}))
    c.write(shape(rows.where("record_id % 3 = 0").withColumn("document", F.concat("source", F.lit(" changed"))), own))
    return c.terms()


@query("SELECT count(*) AS n, count(*) AS n_lsns, true AS later FROM customer")
def lsn_allocation(spark, d):
    """Numbers behind 100 for all customers: each its own."""
    rows = changelog.numbered(table(spark, d, "customer").select("c_custkey"), 100, ["c_custkey"])
    return rows.agg(F.count("*").alias("n"), F.count_distinct("lsn").alias("n_lsns"), (F.min("lsn") > 100).alias("later"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def tenant_read(spark, d):
    """Customers as tenants of a table of orders; one of them is read."""
    path = f"{scratch(spark)}/orders"
    tenants.write(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, "o_custkey", 16)
    return tenants.read(spark, path, "o_custkey", 7, 16)


# The events table as a change log: event_id is the lsn, user_id the key, an error deletes.
def _gone():
    return F.col("event_type") == "error"


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_fold(spark, d):
    return changelog.latest(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
def delete_fold(spark, d):
    return changelog.fold(table(spark, d, "events").select("event_id", "user_id", "event_type"), _gone(), "user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type = 'error'")
def deleted_scan(spark, d):
    return changelog.tombstones(table(spark, d, "events").select("event_id", "user_id", "event_type"), _gone(), "user_id", "event_id").select("user_id", "event_id")


@query("""SELECT event_id, user_id, CASE WHEN lag(event_type) OVER w <> 'error' THEN lag(event_type) OVER w END AS previous_event_type, CASE WHEN lag(event_type) OVER w <> 'error' THEN lag(value) OVER w END AS previous_value
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def preimage(spark, d):
    log = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return changelog.preimages(log, ["event_type", "value"], _gone(), "user_id", "event_id").select("event_id", "user_id", "previous_event_type", "previous_value")


@query("SELECT user_id, event_id, event_type, value FROM events WHERE user_id = 3 ORDER BY event_id DESC LIMIT 1")
def get_record(spark, d):
    log = table(spark, d, "events").where("user_id = 3").select("event_id", "user_id", "event_type", "value")
    return changelog.latest(log, "user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT * FROM events WHERE event_id <= 500 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
def as_of(spark, d):
    return changelog.fold(table(spark, d, "events").select("event_id", "user_id", "event_type"), _gone(), "user_id", "event_id", 500).select("user_id", "event_id")


def _phases(spark, d):
    """Changes, and commit markers (lsn 0) for the keys that have a purchase."""
    e = table(spark, d, "events")
    prepared = e.select(F.col("event_id").alias("lsn"), F.lit("prepare").alias("phase"), F.col("user_id").alias("record_id"), "event_type")
    markers = e.where("event_type = 'purchase'").select(F.lit(0).cast("long").alias("lsn"), F.lit("commit").alias("phase"), F.col("user_id").alias("record_id"), F.lit(None).cast("string").alias("event_type")).distinct()
    return prepared.unionByName(markers)


@query("SELECT event_id AS lsn, user_id AS record_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND event_id > 200")
def replay_committed(spark, d):
    return changelog.replay(_phases(spark, d), 200).select("lsn", "record_id", "event_type")


@query("""SELECT event_id AS lsn, 'prepare' AS phase, user_id AS record_id FROM events WHERE event_id > 900
          UNION ALL SELECT DISTINCT 0, 'commit', user_id FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE event_id > 900)""")
def compact(spark, d):
    return changelog.compacted(_phases(spark, d), 900).select("lsn", "phase", "record_id")


@query("SELECT avg((event_id <= 5)::INT)::DOUBLE AS share, avg((event_id <= 5)::INT) > 0.5 AS worthwhile FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 10)")
def compaction_benefit(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("lsn"))
    return changelog.compaction_benefit(log, 5)


@query("SELECT count(*) + (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'purchase') AS n_entries, count(*) AS n_prepared, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'purchase') AS n_committed, max(event_id) AS max_lsn FROM events")
def log_statistics(spark, d):
    return changelog.log_statistics(_phases(spark, d))


def _accesses(spark, d):
    """Each event is a transaction that writes its user (a view only reads it), open for an hour."""
    e = table(spark, d, "events")
    access = F.when(F.col("event_type") == "view", "read").otherwise("write")
    return e.select(F.col("event_id").alias("version"), F.col("user_id").alias("record_id"), access.alias("access"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("committed_at"))


CONFLICTS = """WITH a AS (SELECT event_id AS version, user_id AS record_id, CASE WHEN event_type = 'view' THEN 'read' ELSE 'write' END AS access, ts AS created_at, ts + INTERVAL 1 HOUR AS committed_at FROM events)
    SELECT a.version, a.record_id, count(*) AS n_others, max_by(b.version, (b.committed_at, b.version)) AS other FROM a JOIN a b USING (record_id)
    WHERE b.access = 'write' AND b.committed_at > a.created_at AND b.committed_at < a.committed_at AND a.access = '{}' GROUP BY ALL"""


@query(CONFLICTS.format("write"))
def conflicts_ww(spark, d):
    return changelog.conflicts(_accesses(spark, d)).where("kind = 'write-write'").drop("kind")


@query(CONFLICTS.format("read"))
def conflicts_rw(spark, d):
    return changelog.conflicts(_accesses(spark, d)).where("kind = 'read-write'").drop("kind")


# An index of ids to places in a file: orders are the index, the blocks found are those of orders with items, some moved or not committed.
def _places(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") * 100).alias("offset"), F.lit(80).cast("long").alias("size"))
    found = o.where("record_id % 17 <> 3").select("record_id", F.when(F.col("record_id") % 13 == 5, F.col("offset") + 1).otherwise(F.col("offset")).alias("offset"), "size", (F.col("record_id") % 11 != 2).alias("committed"))
    return o.where("record_id % 19 <> 4"), found


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey * 100 AS off FROM orders), i AS (SELECT * FROM o WHERE id % 19 <> 4),
          b AS (SELECT id, CASE WHEN id % 13 = 5 THEN off + 1 ELSE off END AS off, id % 11 <> 2 AS ok FROM o WHERE id % 17 <> 3),
          j AS (SELECT coalesce(i.id, b.id) AS record_id, CASE WHEN i.id IS NULL THEN CASE WHEN ok THEN 'not indexed' ELSE 'uncommitted' END WHEN i.off + 80 > 100000 THEN 'beyond the end' WHEN b.id IS NULL THEN 'missing'
                WHEN NOT ok THEN 'uncommitted' WHEN i.off <> b.off THEN 'moved' END AS problem FROM i FULL JOIN b ON i.id = b.id)
          SELECT * FROM j WHERE problem IS NOT NULL""")
def consistency(spark, d):
    return changelog.consistency(*_places(spark, d), file_size=100_000)


@query("SELECT o_orderkey AS record_id, o_orderkey * 100 + 80 > 100000 AS vacuumed FROM orders WHERE o_orderkey % 19 <> 4")
def vacuum_orphans(spark, d):
    index, _ = _places(spark, d)
    kept, gone = changelog.vacuumed(index, index.limit(0), 100_000)
    return kept.select("record_id", F.lit(False).alias("vacuumed")).unionByName(gone.select("record_id", F.lit(True).alias("vacuumed")))


@query("SELECT event_id AS version FROM events WHERE event_type <> 'error' ORDER BY event_id DESC LIMIT 10")
def retained_versions(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("version"), F.when(F.col("event_type") != "error", F.col("ts")).alias("committed_at"))
    return changelog.retained(e).select("version")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 5 = 1")
def overlay_read(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    written = base.where("c_custkey % 5 = 1").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return changelog.overlay(base, written, base.where("c_custkey % 7 = 0").select("c_custkey"), "c_custkey")


# Parts stand in for collections: the size is the dimension, the brand the vector type.
def _catalog(spark, d):
    return table(spark, d, "part").select(F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey")).alias("name"), F.col("p_size").alias("dim"), F.col("p_brand").alias("vector_type"))


PARTS = "(SELECT p_name || ' ' || p_partkey AS name, p_size AS dim, p_brand AS vector_type FROM part)"


@query(f"SELECT name, dim, vector_type FROM {PARTS} WHERE name ILIKE '%A%1%' AND dim >= 10 AND dim <= 30 ORDER BY name")
def catalog_search(spark, d):
    return catalog.search(_catalog(spark, d), "A%1", None, 10, 30)


@query(f"SELECT vector_type, (grouping(vector_type))::TINYINT AS total, count(*) AS n, min(dim) AS min_dim, max(dim) AS max_dim, avg(dim) AS avg_dim FROM {PARTS} GROUP BY ROLLUP (vector_type)")
def catalog_stats(spark, d):
    return catalog.statistics(_catalog(spark, d))


@query("SELECT part.p_partkey FROM part WHERE p_partkey % 10 = 0")
def catalog_integrity(spark, d):
    """Rows with a wrong checksum are found: every tenth is made wrong."""
    rows = _catalog(spark, d).withColumn("p_partkey", F.substring_index("name", " ", -1).cast("long"))
    right = F.sha2(F.concat("name", F.col("dim").cast("string"), "vector_type"), 256)
    return catalog.damaged(rows.withColumn("checksum", F.when(F.col("p_partkey") % 10 == 0, "wrong").otherwise(right))).select("p_partkey")


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def checksums_builtin(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", *(checksums.column_digest(F.col("text"), a).alias(a) for a in ("md5", "sha1", "sha256")))


@query()
def checksums_other(spark, d):
    """crc32 in the JVM, blake2b by a pandas UDF; DuckDB has neither."""
    rows = table(spark, d, "documents")
    return rows.select("doc_id", *(checksums.column_digest(F.col("text"), a).alias(a) for a in ("crc32", "blake2b")))


@query(ORACLES["upsert_fold"])
def stream_fold(spark, d):
    """The change log folded by a stream gives the state that the batch gives."""
    out = scratch(spark)
    schema = table(spark, d, "events").schema
    fold.start(spark, d, schema, out, "user_id", "event_id", watch="events.parquet").awaitTermination()
    return fold.state(spark, out, schema).select("user_id", "event_id", "event_type", "value")


@query()
def tsne(spark, d):
    """A map of all vectors; beyond projection.EXACT_POINTS from neighbours and a grid instead of all pairs."""
    return projection.project(table(spark, d, "embeddings"), 20.0, 42, "vec_id", "embedding")


@query()
def knn_approximate(spark, d):
    return search.approximate(table(spark, d, "embeddings"), first_vector(spark, d), 10, "vec_id", "embedding").select("vec_id", F.round("distance", 6).alias("distance"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
