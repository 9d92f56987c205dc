import json

import pytest
from pyspark.sql import functions as F

from tessel.plans import filters

ROWS = [("oak", "tree", ["leaf", "hard", "acorn"], 1720, 31.5), ("fern", "herb", ["leaf", "spore"], 1650, 0.8), ("pine", "tree", ["hard", "cone"], 1801, 27.25)]
COLUMNS = "id string, kind string, traits array<string>, named int, height double"
ALL = {"oak", "fern", "pine"}
WHERE = [
    ({"kind": "tree"}, {"oak", "pine"}), ({"traits": "leaf"}, {"oak", "fern"}), ({"kind": {"$in": ["tree", "herb"]}}, ALL), ({"kind": ["herb"]}, {"fern"}), ({"kind": {"$in": []}}, set()),
    ({"named": {"$gte": 1720, "$lte": 1801}}, {"oak", "pine"}), ({"height": {"$gt": 0.8, "$lt": 30.0}}, {"pine"}), ({"height": {"$gte": 27.25, "$lt": 31.5}}, {"pine"}),
    ({"traits": {"$in": ["spore", "cone"]}, "named": {"$gte": 1700}}, {"pine"}), ({"named": {"$in": [1650], "$gt": 1800}}, {"fern", "pine"}), ({"colour": "green"}, set()), ({"named": {"$ne": 1650}}, set()),
    ({"named": {}}, set()), ({"named": "1650"}, set()), ({"named": 1650.0}, {"fern"}), ({"kind": {"$gte": "i"}}, {"oak", "pine"}), ({}, ALL), (None, ALL),
]


@pytest.mark.parametrize("wanted,expected", WHERE)
def test_typed_and_dynamic_agree(spark, wanted, expected):
    typed = spark.createDataFrame(ROWS, COLUMNS)
    assert {r.id for r in typed.where(filters.where(wanted, typed.schema)).collect()} == expected
    rows = [(i, json.dumps({"kind": k, "traits": t, "named": n, "height": h})) for i, k, t, n, h in ROWS]
    dynamic = spark.createDataFrame(rows, "id string, m string").withColumn("m", F.parse_json("m"))
    assert {r.id for r in dynamic.where(filters.where(wanted, metadata=F.col("m"))).collect()} == expected


def test_dynamic_values(spark):
    docs = {"a": {"x": True}, "b": {"x": 1}, "c": {"x": "1"}, "d": {"x": None}, "e": {}, "f": {"x": [0, 5]}, "g": {"x": 1.0}, "h": {"it's.odd": 3, "a'b\"c": "q"}, "i": {"x": 9007199254740993}}
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "id string, m string").withColumn("m", F.parse_json("m"))
    found = lambda f: {r.id for r in rows.where(filters.where(f, metadata=F.col("m"))).collect()}
    assert found({"x": 1}) == {"a", "b", "g"}
    assert found({"x": True}) == {"a", "b", "g"}
    assert found({"x": "1"}) == {"c"}
    assert found({"x": None}) == {"d"}
    # Both bounds have to hold for one and the same element.
    assert found({"x": {"$gt": 1, "$lt": 4}}) == set()
    assert found({"x": {"$gte": 5, "$lt": 6}}) == {"f"}
    assert found({"it's.odd": 3}) == found({"a'b\"c": "q"}) == {"h"}
    assert found({"x": 9007199254740993}) == {"i"}
    assert found({"x": {"$gt": 9007199254740992}}) == found({"x": {"$gte": 9007199254740993}}) == {"i"} and found({"x": {"$gt": 9007199254740993}}) == set()
    assert found({"x": {"$gt": 6, "$lt": 9007199254740993}}) == set()


HERONS = "Seven grey herons wait beside slow water at dusk"
DOCUMENT = [
    (None, True), ({}, True), ({"$contains": "grey herons"}, True), ({"$contains": "GREY HERONS"}, False), ({"$contains": ""}, True), ({"$contains": 7}, False), ({"$not_contains": "boat"}, True), ({"$not_contains": "dusk"}, False),
    ({"$contains": "water", "$not_contains": "boat"}, True), ({"$contains": "water", "$near": 1}, False), ({"$and": []}, True), ({"$and": "water"}, False), ({"$and": ["water"]}, False), ({"$and": [{}]}, True),
    ({"$and": [{"$contains": "water"}, {"$contains": "dusk"}]}, True), ({"$or": []}, False), ({"$or": [{"$contains": "boat"}, {"$contains": "dusk"}]}, True), ({"$or": [{"$contains": "boat"}, {"$and": [{"$contains": "slow"}, {"$not_contains": "boat"}]}]}, True),
]


@pytest.mark.parametrize("wanted,expected", DOCUMENT)
def test_documents(spark, wanted, expected):
    rows = spark.createDataFrame([(HERONS,)], "text string")
    assert (rows.where(filters.where_document(wanted, F.col("text"))).count() == 1) is expected


def test_empty_documents_never_match(spark):
    rows = spark.createDataFrame([("",), (None,), ("{}",)], "text string")
    assert rows.where(filters.where_document({"$not_contains": "x"}, F.col("text"), F.lit(False))).count() == 0
    assert rows.where(filters.where_document({"$not_contains": "x"}, F.col("text"), F.lit(True))).count() == 1


def test_typed_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, COLUMNS).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = rows.where(filters.where({"named": {"$gte": 1700}, "kind": "tree"}, rows.schema))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(named,1700)" in plan and "EqualTo(kind,tree)" in plan
