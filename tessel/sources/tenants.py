"""Tables of many tenants: one directory for each slot of a tenant's hash, so that one tenant's read lists one directory."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT = "tenant_slot"


def slot(tenant: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(tenant.cast("string")), F.lit(n)).cast("int")


def write(rows: DataFrame, path: str, tenant: str, n: int = 64, files: int = 1) -> None:
    """files: how many each slot may have, so that a tenant with a third of all rows isn't one task's; its rows go to any of them."""
    placed = rows.withColumn(SLOT, slot(F.col(tenant), n))
    spread = placed.repartition(n * files, F.col(SLOT), F.floor(F.rand(7) * files))
    spread.write.partitionBy(SLOT).parquet(path)


def read(spark: SparkSession, path: str, tenant: str, name, n: int = 64) -> DataFrame:
    """Rows of one tenant. The slot is a constant, which prunes directories; the tenant's name goes to the scan."""
    at = slot(F.lit(name), n)
    return spark.read.parquet(path).where((F.col(SLOT) == at) & (F.col(tenant) == F.lit(name))).drop(SLOT)
