"""The catalog of collections as queries over a small table (name, dim, vector_type, metric, checksum_algorithm, checksum, normalize, resize, pad, created_at, updated_at)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import column_digest

COLUMNS = "name string, dim int, vector_type string, metric string, checksum_algorithm string, checksum string, normalize boolean, resize boolean, pad double, created_at timestamp, updated_at timestamp"


def search(catalog: DataFrame, name_pattern: str | None = None, vector_type: str | None = None, min_dim: int | None = None, max_dim: int | None = None) -> DataFrame:
    """Collections that meet all bounds given, by name. % and _ in the pattern are wildcards, case counts for nothing."""
    if name_pattern:
        catalog = catalog.where(F.col("name").ilike(f"%{name_pattern}%"))
    if vector_type:
        catalog = catalog.where(F.col("vector_type") == vector_type)
    if min_dim is not None:
        catalog = catalog.where(F.col("dim") >= min_dim)
    if max_dim is not None:
        catalog = catalog.where(F.col("dim") <= max_dim)
    return catalog.orderBy("name")


def statistics(catalog: DataFrame) -> DataFrame:
    """Collections by vector type, and one row of null type for all, in one pass."""
    figures = [F.count("*").alias("n"), F.min("dim").alias("min_dim"), F.max("dim").alias("max_dim"), F.avg("dim").alias("avg_dim")]
    return catalog.rollup("vector_type").agg(F.grouping("vector_type").alias("total"), *figures)


def damaged(catalog: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Rows whose checksum isn't that of their columns."""
    return catalog.where(column_digest(F.concat("name", F.col("dim").cast("string"), "vector_type"), algorithm) != F.col("checksum"))


def added(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose name isn't taken; the caller compares counts to tell which were refused."""
    return rows.join(catalog.select("name"), "name", "left_anti")


def dropped(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.where(F.col("name") != name)
