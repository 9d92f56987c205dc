"""From raw documents to token ids: quality, near duplicates, repeated passages, benchmark passages, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. Each works on all rows
that its predecessor kept. All but the last return the columns of documents.

Defined cases are those of the operators; besides, near duplicates go by row, so of repeated rows one stays, with or
without a doc_id; texts that lose bytes to a cut through a character lose the rest of that character too, and n_chars
follows the text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import decontaminate, ngram_join, piece_bpe, quality, suffix_dedup
from tessel.llm.queries import table, tokenizer_file
from tessel.query_pack import scratch

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct, so that none of them meets an operator's own names."""
    others = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("other"))


def together(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents again; n_chars is that of the text."""
    back = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(back.get(c, F.col(f"other.{quoted(c)}")).alias(c) for c in columns))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from whole labelled documents of its input that aren't held out."""
    scored = quality.scored(apart(docs), quality.allowed(table(spark, sf_dir, "labels")), keep=("text", "other"))
    return together(scored.where(F.col("score") >= LEAST_QUALITY), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that chains of similar pairs connect, the one of the smallest doc_id."""
    return together(ngram_join.one_of_each(apart(docs), ("other",)), docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that start earlier too."""
    return together(suffix_dedup.shortened(apart(docs), keep="other"), docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated: less than a twentieth of their words stands in windows of benchmark items."""
    found = decontaminate.hits(apart(docs), table(spark, sf_dir, "benchmark"), keep=("other",))
    return together(decontaminate.judged(found).where(~F.col("contaminated")), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas) and the text decoded from them."""
    return piece_bpe.encoded(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The classifier and the encoder can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Each one's rows are written as Parquet and read back, so no later stage runs it again."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
