"""Versioned state from an append-only change log (lsn, phase, record columns).

The state of a record is its change of the highest lsn. Folding is an aggregation with max_by, so each task combines its
own rows first and a record with very many changes is no hot spot.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "record_id", lsn: str = "lsn", as_of: int | None = None) -> DataFrame:
    """The last change of each key, deletions too."""
    if as_of is not None:
        log = log.where(F.col(lsn) <= as_of)
    columns = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(lsn)).alias("last"))
    return last.select(*(F.col(c) if c == key else F.col(f"last.{c}").alias(c) for c in log.columns))


def fold(log: DataFrame, deleted: Column, key: str = "record_id", lsn: str = "lsn", as_of: int | None = None) -> DataFrame:
    """Live rows at a version. deleted: whether a change deletes."""
    return latest(log, key, lsn, as_of).where(~F.coalesce(deleted, F.lit(False)))


def tombstones(log: DataFrame, deleted: Column, key: str = "record_id", lsn: str = "lsn") -> DataFrame:
    """Keys whose last change deletes."""
    return latest(log, key, lsn).where(F.coalesce(deleted, F.lit(False)))


def preimages(log: DataFrame, columns: list[str], deleted: Column, key: str = "record_id", lsn: str = "lsn") -> DataFrame:
    """Each change with what the record was before: previous_<column>, null where it didn't exist or was deleted."""
    order = Window.partitionBy(key).orderBy(lsn)
    rows = log.withColumn("gone", F.coalesce(deleted, F.lit(False)))
    before = {f"previous_{c}": F.when(~F.lag("gone").over(order), F.lag(c).over(order)) for c in columns}
    return rows.select("*", *(v.alias(k) for k, v in before.items())).drop("gone")


def batch_preimages(batch: DataFrame, state: DataFrame, key: str = "record_id") -> DataFrame:
    """For a batch of one change for each key: the record's current row, null where there's none."""
    columns = [F.col(c).alias(f"previous_{c}") for c in state.columns if c != key]
    return batch.join(state.select(key, *columns), key, "left")


def committed(log: DataFrame, key: str = "record_id") -> DataFrame:
    """Prepared changes of all keys that have a commit marker. One marker releases all changes of its key."""
    markers = log.where("phase = 'commit'").select(key).distinct()
    return log.where("phase = 'prepare'").join(markers, key, "left_semi")


def replayed(log: DataFrame, visible_lsn: int, key: str = "record_id", lsn: str = "lsn") -> DataFrame:
    """Committed changes that a state at visible_lsn lacks; replaying twice changes nothing."""
    return committed(log, key).where(F.col(lsn) > visible_lsn)


def replay(log: DataFrame, visible_lsn: int, key: str = "record_id", lsn: str = "lsn") -> DataFrame:
    """replayed(), in the order in which changes are to be applied one by one. A fold needs no order."""
    return replayed(log, visible_lsn, key, lsn).orderBy(lsn)


def compacted(log: DataFrame, visible_lsn: int, key: str = "record_id", lsn: str = "lsn") -> DataFrame:
    """The log without prepared changes at or below visible_lsn; markers stay while a newer change of their key needs them."""
    newer = log.where((F.col("phase") == "prepare") & (F.col(lsn) > visible_lsn))
    markers = log.where("phase = 'commit'").join(newer.select(key).distinct(), key, "left_semi")
    return newer.unionByName(markers.select(*newer.columns))


def compaction_benefit(log: DataFrame, visible_lsn: int, lsn: str = "lsn", sample: int = 10) -> DataFrame:
    """(share, worthwhile) over the first entries of the log: more than half of them are old."""
    first = log.orderBy(lsn).limit(sample)
    return first.agg(F.avg((F.col(lsn) <= visible_lsn).cast("double")).alias("share")).withColumn("worthwhile", F.coalesce(F.col("share") > 0.5, F.lit(False)))


def log_statistics(log: DataFrame, lsn: str = "lsn") -> DataFrame:
    return log.agg(F.count("*").alias("n_entries"), F.count_if(F.col("phase") == "prepare").alias("n_prepared"), F.count_if(F.col("phase") == "commit").alias("n_committed"), F.max(lsn).alias("max_lsn"))


def numbered(batch: DataFrame, after: int, order: list[str], lsn: str = "lsn") -> DataFrame:
    """A batch with the next lsns: unique and increasing in `order`, with gaps between tasks, so that no task sees all rows."""
    spread = batch.repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.withColumn(lsn, F.lit(after) + 1 + F.monotonically_increasing_id())


def conflicts(accesses: DataFrame) -> DataFrame:
    """(version, record_id, kind, n_others, other): versions that others' commits to a record contradict, which came after the version began
    and, unless it's open, before it ended. n_others: how many commits; other: the version of the last one (of equal times, the largest).

    accesses: (version, record_id, access: read or write, created_at, committed_at, null while open), a version's all alike.
    Beginnings, ends and commits of a record run past once, in order of time, so a record that very many versions write
    costs as many rows, not their pairs.
    """
    mine = accesses.select("version", "record_id", "access", "created_at", "committed_at").distinct()
    writes = mine.where("access = 'write' and committed_at is not null")
    none = F.lit(None).cast(mine.schema["version"].dataType)
    points = [  # of one time: ends see no commit of that time, beginnings all
        mine.select("record_id", "version", "access", F.col("committed_at").alias("at"), F.lit(0).alias("what"), none.alias("writer")),
        writes.select("record_id", "version", "access", F.col("committed_at").alias("at"), F.lit(1).alias("what"), F.col("version").alias("writer")),
        mine.select("record_id", "version", "access", F.col("created_at").alias("at"), F.lit(2).alias("what"), none.alias("writer")),
    ]
    line = points[0].unionByName(points[1]).unionByName(points[2])
    so_far = Window.partitionBy("record_id").orderBy(F.asc_nulls_last("at"), "what", F.asc_nulls_first("writer")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = line.select("*", F.count("writer").over(so_far).alias("n"), F.last("writer", ignorenulls=True).over(so_far).alias("last")).where("what <> 1")
    ends = seen.groupBy("version", "record_id", "access").agg(
        (F.max(F.when(F.col("what") == 0, F.col("n"))) - F.max(F.when(F.col("what") == 2, F.col("n")))).alias("n_others"), F.max(F.when(F.col("what") == 0, F.col("last"))).alias("other")
    )
    kind = F.when(F.col("access") == "write", "write-write").otherwise("read-write")
    return ends.where("n_others > 0").select("version", "record_id", kind.alias("kind"), "n_others", "other")


def consistency(index: DataFrame, blocks: DataFrame, file_size: int, key: str = "record_id") -> DataFrame:
    """(key, problem) of an id -> (offset, size) index against the blocks (offset, size, committed) found in a file, by one full outer join."""
    i = index.select(key, F.col("offset").alias("i_offset"), F.col("size").alias("i_size"))
    b = blocks.select(key, F.col("offset").alias("b_offset"), F.col("size").alias("b_size"), "committed")
    problem = (
        F.when(F.col("i_offset").isNull(), F.when(F.col("committed"), "not indexed").otherwise("uncommitted"))
        .when(F.col("i_offset") + F.col("i_size") > file_size, "beyond the end")
        .when(F.col("b_offset").isNull(), "missing")
        .when(~F.col("committed"), "uncommitted")
        .when((F.col("i_offset") != F.col("b_offset")) | (F.col("i_size") != F.col("b_size")), "moved")
    )
    return i.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def vacuumed(index: DataFrame, deleted: DataFrame, file_size: int) -> tuple[DataFrame, DataFrame]:
    """The index without rows beyond the file's end, and the deleted rows with them."""
    beyond = F.col("offset") + F.col("size") > file_size
    return index.where(~beyond), deleted.unionByName(index.where(beyond))


def retained(versions: DataFrame, keep: int = 10) -> DataFrame:
    """The newest committed versions."""
    return versions.where("committed_at is not null").orderBy(F.desc("version")).limit(keep)


def overlay(base: DataFrame, written: DataFrame, removed: DataFrame, key: str = "record_id") -> DataFrame:
    """What an open transaction reads: the base without what it removed or wrote, and what it wrote."""
    touched = written.select(key).unionByName(removed.select(key))
    return base.join(touched, key, "left_anti").unionByName(written)
