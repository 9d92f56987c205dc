"""Cutting lineage through the shared checkpoint folder, and cutting Arrow batches to a bounded size."""

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a new temporary one, which only a local master can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df, written as a table of its own to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, column: str = "text", most: int = 2_000_000):
    """Arrow batches of whole rows with about `most` bytes of text each at the most; a longer text comes alone."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        sizes = np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64)
        total, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
