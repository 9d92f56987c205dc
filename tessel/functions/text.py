"""Terms and field paths of documents as tables, which a join or filter can use like an inverted index."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Distinct lower-cased words; letters, digits, marks and underscores of any script form words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1))


def term_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key): one row for each document and distinct term."""
    return docs.select(F.explode(terms(F.col(text))).alias("term"), key)


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, n_docs): combined within each task before the shuffle."""
    return term_rows(docs, key, text).groupBy("term").agg(F.count("*").alias("n_docs"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, ids): whole posting lists. A frequent term's list is as long as the table; term_rows() has no such row."""
    return term_rows(docs, key, text).groupBy("term").agg(F.sort_array(F.collect_set(key)).alias("ids"))


def field_rows(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(path, value, key): dotted paths of JSON objects, each element of a list by itself, an object also as a whole.

    Values are texts as Python writes them: True, False, None, 1.5. A job for each level looks whether objects are left.
    """
    level = docs.select(key, F.try_parse_json(F.col(json)).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT")).select(key, F.lit("").alias("path"), "v")
    out, left = None, True
    while left:
        below = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("name"), F.col("value").alias("child")))
        below = below.select(key, F.concat("path", "name").alias("path"), F.col("child").alias("v"))
        kind = F.schema_of_variant("v")
        items = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
        found = below.select("path", F.explode(items).alias("item"), key)
        found = found.select("path", python_text(F.col("item")).alias("value"), key)
        out = found if out is None else out.unionByName(found)
        level = below.where(kind.startswith("OBJECT")).select(key, F.concat("path", F.lit(".")).alias("path"), "v")
        left = not level.isEmpty()
    return out.distinct()


def python_text(v: Column) -> Column:
    """A variant scalar as Python's str() writes it; objects and lists as JSON."""
    kind, text = F.schema_of_variant(v), F.to_json(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .otherwise(text)
    )
