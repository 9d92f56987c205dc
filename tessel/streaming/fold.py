"""A change log folded by Structured Streaming.

Each micro-batch of committed changes is reduced to its last change for each record and merged with the state; the
record of the higher lsn wins, so a batch that is delivered again changes nothing. States are numbered directories that a
pointer makes valid (see sources.collection), and the stream's checkpoint holds the offsets.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import changelog
from ..sources.collection import Versions


def start(spark: SparkSession, log_path: str, schema: StructType, out: str, key: str = "record_id", lsn: str = "lsn", watch: str | None = None, files_per_batch: int = 64, log_filter: Column | None = None) -> StreamingQuery:
    """Folds all files of the log that are there and stops; run it again for what has come since. out: state and checkpoint."""
    states = Versions(spark, out, "state", "pointer")
    columns = schema.fieldNames()

    def merge(batch: DataFrame, _: int) -> None:
        n, seen = states.current()
        both = batch.select(*columns)
        if n:
            both = both.unionByName(spark.read.schema(schema).parquet(states.path(n)))
        last = changelog.latest(both, key, lsn)
        top = batch.agg(F.max(lsn)).first()[0]
        states.write(last, max(seen, top or 0))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if watch:
        stream = stream.option("pathGlobFilter", watch)
    rows = stream.parquet(log_path)
    if log_filter is not None:
        rows = rows.where(log_filter)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def state(spark: SparkSession, out: str, schema: StructType, deleted: Column | None = None) -> DataFrame:
    """The folded state so far; deleted: which last changes delete."""
    n, _ = Versions(spark, out, "state", "pointer").current()
    rows = spark.read.schema(schema).parquet(Versions(spark, out, "state", "pointer").path(n)) if n else spark.createDataFrame([], schema)
    return rows if deleted is None else rows.where(~F.coalesce(deleted, F.lit(False)))
