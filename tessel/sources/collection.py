"""Collections in a directory: an append-only change log, snapshots of the folded state, and a pointer to the newest one.

    <root>/<name>/log-<n>/      Parquet of LOG_TYPE, one append for each write; compaction writes the next n
    <root>/<name>/snapshot-<n>/ live records at a visible lsn
    <root>/<name>/pointer/      (n, visible_lsn), appended after its snapshot is complete; the highest n counts
    <root>/<name>/terms-<n>/    (term, record_id) at an lsn, where index() was called; fields-<n>/ (path, value, record_id)
    <root>/catalog-<n>/         the catalog; <root>/catalog-pointer/ as above

Spark's readers and writers do all input and output, so any store they reach will do. A write is one append, which a
committer makes visible as a whole; nothing is ever changed in place. One writer for each collection is assumed, and
checked: a write based on an older lsn is refused if its records changed since, or if the lsn is older than the compaction
of the log, after which that can't be told. The last KEEP snapshots, logs and preimages stay; a state of the past is read
from the newest snapshot before it and the log behind that. Snapshots and derived tables are laid out by ranges of their
first column, sorted within files, so a point or range read skips files and row groups by their statistics.
"""

import threading
from collections.abc import Iterable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CollectionExists, CollectionNotFound, DimensionMismatch, InvalidRecord, ReadWriteConflict, RecordNotFound, StorageError, WriteConflict
from ..functions import checksums, text, vectors
from ..operators import catalog, changelog, projection, search, strategies
from ..plans import filters
from ..schema import LOG_TYPE, RECORD_TYPE, TOMBSTONE, CollectionSchema, Record, SearchRequest, split_valid


#: Versions of a directory that stay; older ones are deleted.
KEEP = 10
#: A log of more entries, or one whose first entries are mostly old, is worth a compaction.
LOG_ENTRIES = 1_000_000
#: The derived tables and the column each is laid out by.
FIRST = {"terms": "term", "fields": "path"}


def _deleted():
    return F.col("kind") == TOMBSTONE


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def clustered(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in ranges of the columns, one for each file, sorted within it."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the Parquet files of a directory; their contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    try:
        return found.load(path).select("path", "length")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "path string, length long")
        raise


class Versions:
    """Numbered directories with a pointer table that names the valid ones."""

    def __init__(self, spark: SparkSession, base: str, label: str, pointer: str):
        self.spark, self.base, self.label, self.pointer = spark, base, label, f"{base}/{pointer}"

    def current(self) -> tuple[int, int]:
        """(number, lsn) of the newest version; (0, 0) for none."""
        row = read_or_empty(self.spark, self.pointer, "n long, lsn long").orderBy(F.desc("n")).limit(1).collect()
        return (row[0].n, row[0].lsn) if row else (0, 0)

    def path(self, n: int) -> str:
        return f"{self.base}/{self.label}-{n}"

    def kept(self) -> list[tuple[int, int]]:
        """(number, lsn) of the versions that are still there, the newest first."""
        rows = read_or_empty(self.spark, self.pointer, "n long, lsn long").orderBy(F.desc("n")).limit(KEEP).collect()
        return [(r.n, r.lsn) for r in rows]

    def retire(self, n: int) -> None:
        """Deletes the version that has become one too many."""
        if n >= 0:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(n))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, df: DataFrame, lsn: int = 0) -> int:
        n = self.current()[0] + 1
        self.retire(n - KEEP)
        df.write.mode("overwrite").parquet(self.path(n))
        self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(lsn).cast("long").alias("lsn")).write.mode("append").parquet(self.pointer)
        return n


class Collection:
    def __init__(self, spark: SparkSession, root: str, schema: CollectionSchema):
        self.spark, self.schema, self.base = spark, schema, f"{root}/{schema.name}"
        self.snapshots = Versions(spark, self.base, "snapshot", "pointer")
        self.preimages = Versions(spark, self.base, "preimages", "preimages-pointer")
        self.derived = {label: Versions(spark, self.base, label, f"{label}-pointer") for label in FIRST}

        self.logs = Versions(spark, self.base, "log", "log-pointer")
        self.log_path = self.logs.path(self.logs.current()[0])
        self.lock = threading.RLock()  # writers of this process take turns; readers need no lock

    @property
    def log(self) -> DataFrame:
        return read_or_empty(self.spark, self.log_path, LOG_TYPE)

    def max_lsn(self) -> int:
        return max(self.log.agg(F.max("lsn")).first()[0] or 0, self.snapshots.current()[1])

    def compacted_lsn(self) -> int:
        """The log holds all changes behind this lsn."""
        return self.logs.current()[1]

    def _snapshot(self, n: int) -> DataFrame:
        return self.spark.read.schema(RECORD_TYPE).parquet(self.snapshots.path(n)) if n else self.spark.createDataFrame([], RECORD_TYPE)

    def _folded(self, n: int, visible: int, log: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """A snapshot with the committed changes behind it; of certain keys only, which are picked before anything is folded."""
        held = self._snapshot(n)
        if keys is not None:
            held, log = (x.join(keys, "record_id", "left_semi") for x in (held, log))
        base = held.select(F.lit(visible).cast("long").alias("lsn"), F.lit("prepare").alias("phase"), *RECORD_TYPE.names)
        tail = changelog.replayed(log, visible).select(*LOG_TYPE.names)
        return changelog.fold(base.unionByName(tail), _deleted()).select(*RECORD_TYPE.names)

    def ids(self) -> DataFrame:
        """record_id of all live records."""
        return self.read().select("record_id")

    def read(self, mode: str = "latest", as_of: int | None = None, lag_bound: int | None = None, min_lsn: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Live records; keys: of these record_ids only.

        latest: all committed changes. visible: the newest snapshot. bounded: the snapshot if it's at most lag_bound
        changes behind, else latest. session: the snapshot if it holds min_lsn, else latest. as_of: the state at an lsn.
        """
        if as_of is not None:
            n, visible = next(((n, lsn) for n, lsn in self.snapshots.kept() if lsn <= as_of), (0, 0))
            if self.compacted_lsn() > visible:
                raise StorageError(f"the log behind lsn {visible}, the newest snapshot before {as_of}, is compacted")
            return self._folded(n, visible, self.log.where(F.col("lsn") <= as_of), keys)
        n, visible = self.snapshots.current()
        held = self._snapshot(n) if keys is None else self._snapshot(n).join(keys, "record_id", "left_semi")
        if mode == "visible":
            return held
        if mode == "bounded" and self.log.where((F.col("lsn") > visible) & (F.col("phase") == "prepare")).count() <= (lag_bound or 0):
            return held
        if mode == "session" and visible >= (min_lsn or 0):
            return held
        if mode not in ("latest", "bounded", "session"):
            raise InvalidRecord(f"unknown read mode {mode}")
        return self._folded(n, visible, self.log, keys)

    def write(self, changes: DataFrame, base_lsn: int | None = None, reads: Iterable[str] = ()) -> DataFrame:
        """Appends changes (rows of RECORD_TYPE, at most one for each record) and returns their preimages.

        base_lsn: what the writer has read; a record that changed since makes the write fail, be it one to be written or,
        of those in reads, one that was read.
        """
        changes = changes.select(*RECORD_TYPE.names)
        good, bad = split_valid(changes, None if self.schema.resize else self.schema.dim)
        wrong = bad.limit(1).collect()
        if wrong:
            error = DimensionMismatch if wrong[0].problem == "wrong dimension" else InvalidRecord
            raise error(f"{wrong[0].record_id}: {wrong[0].problem}")
        twice = good.groupBy("record_id").count().where("count > 1").limit(1).collect()
        if twice:
            raise InvalidRecord(f"{twice[0].record_id}: two changes in one batch")
        with self.lock:
            return self._append(good, base_lsn, list(reads))

    def _append(self, good: DataFrame, base_lsn: int | None, reads: list[str]) -> DataFrame:
        last = self.max_lsn()
        if base_lsn is not None and base_lsn < last:
            if base_lsn < self.compacted_lsn():
                raise WriteConflict(f"what changed since lsn {base_lsn} is compacted: read again")
            since = self.log.where(F.col("lsn") > base_lsn)
            for ids, error in ((good.select("record_id"), WriteConflict), (self.spark.createDataFrame([(i,) for i in reads], "record_id string"), ReadWriteConflict)):
                met = since.join(ids, "record_id", "left_semi").limit(1).collect()
                if met:
                    raise error(met[0].record_id)
        # The preimage is fixed before the append: a lazy read would see the new state.
        keys = good.select("record_id")
        n = self.preimages.write(changelog.batch_preimages(keys, self.read(keys=keys)), last)
        # A change and its marker come from one row, so they have one lsn however often the rows are numbered.
        numbered = changelog.numbered(good, last, ["record_id"])
        prepared = F.struct("lsn", F.lit("prepare").alias("phase"), *RECORD_TYPE.names)
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD_TYPE.fields[2:]]
        marker = F.struct("lsn", F.lit("commit").alias("phase"), "record_id", F.lit("RECORD").alias("kind"), *empty)
        numbered.select(F.explode(F.array(prepared, marker)).alias("row")).select("row.*").write.mode("append").parquet(self.log_path)
        return self.spark.read.parquet(self.preimages.path(n))

    def insert(self, records: Iterable[Record], base_lsn: int | None = None, reads: Iterable[str] = ()) -> list[Record]:
        """Upserts and returns what was there before."""
        records = list(records)
        for r in records:
            if r.vector is not None and r.vector.size != self.schema.dim and not self.schema.resize:
                raise DimensionMismatch(f"{r.record_id}: {r.vector.size} components instead of {self.schema.dim}")
        return self._preimages(self.write(self.spark.createDataFrame([r.row() for r in records], RECORD_TYPE), base_lsn, reads), [r.record_id for r in records])

    def delete(self, ids: Iterable[str], base_lsn: int | None = None, reads: Iterable[str] = ()) -> list[Record]:
        """Deletes and returns what was there before; an unknown id is no error."""
        ids = list(ids)
        return self._preimages(self.write(self.spark.createDataFrame([Record.tombstone(i).row() for i in ids], RECORD_TYPE), base_lsn, reads), ids)

    def _preimages(self, before: DataFrame, ids: list[str]) -> list[Record]:
        found = {r.record_id: r for r in before.where("previous_kind is not null").select("record_id", *(F.col(f"previous_{c}").alias(c) for c in RECORD_TYPE.names[1:])).collect()}
        return [Record.from_row(found[i]) if i in found else Record.nonexistent(i) for i in ids]

    def get(self, record_id: str) -> Record:
        """The filter reaches the scans of the snapshot and the log."""
        rows = self.read().where(F.col("record_id") == record_id).collect()
        if not rows:
            raise RecordNotFound(record_id)
        record = Record.from_row(rows[0])
        record.validate()
        return record

    def filtered(self, request: SearchRequest, rows: DataFrame | None = None) -> DataFrame:
        rows = (self.read() if rows is None else rows).withColumn("meta", F.try_parse_json("metadata"))
        condition = filters.where(request.where, metadata=F.col("meta")) & filters.where_document(request.where_document, F.col("document"), F.col("document_is_text"))
        return rows.where(condition).drop("meta")

    def shaped(self, vector: Column) -> Column:
        """A vector as this collection compares it."""
        if self.schema.resize:
            vector = vectors.fitted(vector, self.schema.dim, self.schema.pad)
        return vectors.normalized(vector) if self.schema.normalize else vector

    @staticmethod
    def _derive(label: str, records: DataFrame) -> DataFrame:
        if label == "terms":
            return text.term_rows(records.where("document_is_text"), "record_id", "document")
        return text.field_rows(records.where("not document_is_text"), "record_id", "document")

    def index(self) -> int:
        """Writes the term and field tables anew, from the state at the lsn that is returned; from then on flush() keeps them up to date."""
        with self.lock:
            last, state = self.max_lsn(), self.read()
            for label, versions in self.derived.items():
                versions.write(clustered(self._derive(label, state), FIRST[label], "record_id"), last)
        return last

    def _postings(self, label: str) -> DataFrame:
        """A derived table as of now: what is kept, without the records that changed since, and what these hold now.

        Without a kept table, or with one from before the log's compaction, all comes from the records.
        """
        n, lsn = self.derived[label].current()
        if not n or lsn < self.compacted_lsn():
            return self._derive(label, self.read())
        changed = changelog.replayed(self.log, lsn).select("record_id").distinct()
        held = self.spark.read.parquet(self.derived[label].path(n)).join(changed, "record_id", "left_anti")
        return held.unionByName(self._derive(label, self.read(keys=changed)))

    def terms(self) -> DataFrame:
        """(term, record_id) of all live records whose document is a text."""
        return self._postings("terms").select("term", "record_id")

    def fields(self) -> DataFrame:
        """(path, value, record_id) of all live records whose document is an object."""
        return self._postings("fields").select("path", "value", "record_id")

    def search(self, request: SearchRequest, mode: str = "latest", strategy: str = "exact") -> DataFrame:
        """The k nearest records that pass both filters, with rank and distance. A result whose checksum isn't that of its content fails the query.

        strategy: one of strategies.STRATEGIES.
        """
        request.validate(None if self.schema.resize else self.schema.dim)
        rows = self.filtered(request, self.read(mode)).withColumn("compared", self.shaped(F.col("vector")))
        query = self.shaped(vectors.doubles(request.vector.tolist()))
        found = strategies.strategy(strategy)(rows, query, request.k, request.metric or self.schema.metric, "record_id", "compared").drop("compared")
        sound = checksums.record_digest(F.struct(*RECORD_TYPE.names)) == F.col("checksum")
        checked = F.when(F.col("checksum").isNull() | sound, True).otherwise(F.raise_error(F.concat(F.lit("checksum mismatch: "), "record_id")).cast("boolean"))
        return found.where(checked).orderBy("rank")

    def search_batch(self, queries: DataFrame, k: int, metric: str | None = None) -> DataFrame:
        """queries: (query_id, vector)."""
        rows, queries = (x.withColumn("vector", self.shaped(F.col("vector"))) for x in (self.read(), queries))
        return search.knn_batch(rows, queries, k, metric or self.schema.metric)

    def tsne(self, ids: list[str] | None = None, perplexity: float = 30.0, seed: int = 42) -> DataFrame:
        rows = self.read()
        return projection.project(rows if ids is None else rows.where(F.col("record_id").isin(ids)), perplexity, seed)

    def flush(self) -> int:
        """Writes a snapshot of all committed changes; returns its visible lsn."""
        with self.lock:
            last = self.max_lsn()
            self.snapshots.write(clustered(self.read(), "record_id"), last)
            for label, versions in self.derived.items():
                if versions.current()[0]:
                    versions.write(clustered(self._postings(label), FIRST[label], "record_id"), last)
        return last

    def compact(self) -> None:
        """Rewrites the log without what the newest snapshot holds. The state a reader sees stays the same."""
        with self.lock:
            self._compact()

    def _compact(self) -> None:
        _, visible = self.snapshots.current()
        n = self.logs.write(changelog.compacted(self.log, visible).select(*LOG_TYPE.names), visible)
        self.log_path = self.logs.path(n)

    def log_statistics(self) -> DataFrame:
        """One row: changelog.log_statistics() with n_files, n_bytes and needs_compaction."""
        size = files(self.spark, self.log_path).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes")).first()
        visible = self.snapshots.current()[1]
        old = changelog.compaction_benefit(self.log.where("phase = 'prepare'"), visible).first().worthwhile
        needed = (F.col("n_entries") > LOG_ENTRIES) | F.lit(bool(old))
        return changelog.log_statistics(self.log).select("*", F.lit(size.n_files).alias("n_files"), F.lit(size.n_bytes).alias("n_bytes"), needed.alias("needs_compaction"))

    def unreadable(self) -> list[str]:
        """Files of the log that can't be read. Reads and writes of a collection with such a file fail, and change nothing."""
        listed = files(self.spark, self.log_path).select(F.substring_index("path", "/", -1).alias("file"))
        rows = self.spark.read.schema(LOG_TYPE).option("ignoreCorruptFiles", True)
        suspects = listed
        if not listed.isEmpty():  # a file whose rows come is sound; what is left is damaged or has no rows
            seen = rows.parquet(self.log_path).select(F.col("_metadata.file_name").alias("file"), "lsn").where("lsn is not null").select("file").distinct()
            suspects = listed.join(seen, "file", "left_anti")
        bad = []
        for r in suspects.orderBy("file").toLocalIterator():
            try:
                self.spark.read.schema(LOG_TYPE).parquet(f"{self.log_path}/{r.file}").agg(F.max("lsn")).collect()
            except Exception:  # whatever the reader raises, the file can't be read
                bad.append(r.file)
        return bad

    def checked(self) -> "Collection":
        """This collection; a damaged log is an error that names the files."""
        bad = self.unreadable()
        if bad:
            raise StorageError(f"{self.log_path}: unreadable files: {', '.join(bad)}")
        return self

    def repair(self) -> list[str]:
        """Goes on with a log of the readable files; returns the others' names. The damaged log's directory stays as a version of its own."""
        with self.lock:
            bad = self.unreadable()
            if bad:
                sound = self.spark.read.schema(LOG_TYPE).option("ignoreCorruptFiles", True).parquet(self.log_path)
                self.log_path = self.logs.path(self.logs.write(sound, self.compacted_lsn()))
        return bad

    def checkpoint(self) -> None:
        """A snapshot, then a compaction where it pays: what closing a collection does."""
        self.flush()
        if self.log_statistics().first().needs_compaction:
            self.compact()

    def verify(self) -> DataFrame:
        """Log rows whose checksum isn't that of their content."""

        @F.pandas_udf("boolean")
        def sound(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([Record.from_row(r).computed() == r.checksum for r in rows.itertuples(index=False)], dtype=bool)

        return self.log.where("phase = 'prepare'").where(~sound(F.struct(*RECORD_TYPE.names)))


class Store:
    """A root directory with its catalog: the engine's client."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, self.root, "catalog", "catalog-pointer")

    @property
    def catalog(self) -> DataFrame:
        n, _ = self.versions.current()
        return self.spark.read.schema(catalog.COLUMNS).parquet(self.versions.path(n)) if n else self.spark.createDataFrame([], catalog.COLUMNS)

    def create_collection(self, schema: CollectionSchema) -> Collection:
        if not self.catalog.where(F.col("name") == schema.name).isEmpty():
            raise CollectionExists(schema.name)
        row = self.spark.createDataFrame([(schema.name, schema.dim, schema.vector_type, schema.metric, schema.checksum_algorithm, schema.checksum, schema.normalize, schema.resize, schema.pad)], catalog.COLUMNS.split(", created_at")[0])
        self.versions.write(self.catalog.unionByName(row.select("*", F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))))
        return Collection(self.spark, self.root, schema)

    def collection(self, name: str) -> Collection:
        rows = self.catalog.where(F.col("name") == name).collect()
        if not rows:
            raise CollectionNotFound(name)
        r = rows[0]
        return Collection(self.spark, self.root, CollectionSchema(r.name, r.dim, r.vector_type, r.metric, r.checksum_algorithm, r.checksum, bool(r.normalize), bool(r.resize), r.pad or 0.0))

    def find(self, name_pattern: str | None = None, vector_type: str | None = None, min_dim: int | None = None, max_dim: int | None = None) -> DataFrame:
        """Rows of the catalog that meet all bounds given."""
        return catalog.search(self.catalog, name_pattern, vector_type, min_dim, max_dim)

    def damaged(self) -> DataFrame:
        """Rows of the catalog whose checksum isn't that of their columns."""
        return catalog.damaged(self.catalog)

    def list_collections(self) -> list[str]:
        return [r.name for r in catalog.search(self.catalog).select("name").collect()]

    def drop_collection(self, name: str) -> CollectionSchema | None:
        """Takes the name out of the catalog and returns its schema, or None; its files stay."""
        try:
            schema = self.collection(name).schema
        except CollectionNotFound:
            return None
        self.versions.write(catalog.dropped(self.catalog, name))
        return schema

    def close(self) -> None:
        """Checkpoints every collection. Nothing is held open, so a store can be used again afterwards."""
        for name in self.list_collections():
            self.collection(name).checkpoint()

    def backup(self, path: str) -> None:
        self.catalog.write.parquet(path)
