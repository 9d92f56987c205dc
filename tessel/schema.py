"""The data model: records, collections, search requests, and their checks."""

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ChecksumMismatch, DimensionMismatch, EmptyVector, InvalidRecord
from .functions.checksums import canonical, digest, record_bytes, request_bytes

RECORD, TOMBSTONE, NONEXISTENT = "RECORD", "TOMBSTONE", "NONEXISTENT"

#: One state of a record. document is its canonical text; metadata is JSON, read as VARIANT.
RECORD_TYPE = T.StructType([
    T.StructField("record_id", T.StringType(), False), T.StructField("kind", T.StringType(), False), T.StructField("vector", T.ArrayType(T.FloatType(), False)),
    T.StructField("document", T.StringType()), T.StructField("document_is_text", T.BooleanType()), T.StructField("metadata", T.StringType()),
    T.StructField("checksum", T.StringType()), T.StructField("checksum_algorithm", T.StringType()),
])
#: A row of a change log: prepared changes and the markers that commit them.
LOG_TYPE = T.StructType([T.StructField("lsn", T.LongType(), False), T.StructField("phase", T.StringType(), False), *RECORD_TYPE.fields])


@dataclass(frozen=True)
class CollectionSchema:
    name: str
    dim: int
    vector_type: str = "float32"
    metric: str = "l2"
    checksum_algorithm: str = "sha256"
    checksum: str = field(default="", compare=False)
    #: Searches compare vectors scaled to length 1; cut or padded to dim, so that records may have vectors of any length.
    normalize: bool = False
    resize: bool = False
    pad: float = 0.0

    def __post_init__(self):
        if not self.name or self.dim < 1:
            raise InvalidRecord("a collection needs a name and a dimension of at least 1")
        if not self.checksum:
            object.__setattr__(self, "checksum", self.computed())

    def computed(self) -> str:
        return digest(f"{self.name}{self.dim}{self.vector_type}".encode(), self.checksum_algorithm)


@dataclass(eq=False)
class Record:
    """A record, a tombstone, or the answer that there's none."""

    record_id: str
    vector: Any = None
    document: Any = None
    metadata: dict | None = None
    kind: str = RECORD
    checksum_algorithm: str = "sha256"
    checksum: str = ""

    def __post_init__(self):
        if self.kind == RECORD:
            if self.vector is None or (self.document is None and self.metadata is None):
                raise InvalidRecord("a record needs a vector, and a document or metadata")
            self.vector = np.asarray(self.vector, dtype=np.float32).ravel()
            if not self.vector.size:
                raise EmptyVector("a vector needs components")
            for value in (self.metadata or {}).values():
                if any(isinstance(x, dict) for x in (value if isinstance(value, list | tuple | set) else [value])):
                    raise InvalidRecord("metadata values are scalars or lists of scalars")
        elif (self.vector, self.document, self.metadata) != (None, None, None):
            raise InvalidRecord(f"a {self.kind} holds neither vector, document nor metadata")
        if not self.checksum:
            self.checksum = self.computed()

    @classmethod
    def tombstone(cls, record_id: str) -> "Record":
        return cls(record_id, kind=TOMBSTONE)

    @classmethod
    def nonexistent(cls, record_id: str) -> "Record":
        return cls(record_id, kind=NONEXISTENT)

    def __eq__(self, other) -> bool:
        return isinstance(other, Record) and self.row() == other.row()

    def __hash__(self) -> int:
        return hash((self.record_id, self.checksum))

    def computed(self) -> str:
        meta = None if self.metadata is None else {k: sorted(v, key=str) if isinstance(v, set) else v for k, v in self.metadata.items()}
        return digest(record_bytes(self.kind, self.record_id, self.document, self.vector, meta), self.checksum_algorithm)

    def validate(self) -> None:
        if self.computed() != self.checksum:
            raise ChecksumMismatch(self.record_id)

    def row(self) -> tuple:
        """In the order of RECORD_TYPE."""
        is_text = None if self.document is None else isinstance(self.document, str)
        text = self.document if is_text else None if self.document is None else canonical(self.document)
        meta = None if self.metadata is None else canonical({k: sorted(v, key=str) if isinstance(v, set) else v for k, v in self.metadata.items()})
        return (self.record_id, self.kind, None if self.vector is None else [float(x) for x in self.vector], text, is_text, meta, self.checksum, self.checksum_algorithm)

    @classmethod
    def from_row(cls, row) -> "Record":
        import json

        document = row.document if row.document is None or row.document_is_text else json.loads(row.document)
        meta = None if row.metadata is None else json.loads(row.metadata)
        return cls(row.record_id, row.vector, document, meta, row.kind, row.checksum_algorithm, row.checksum)


@dataclass
class SearchRequest:
    vector: Any
    k: int
    where: dict | None = None
    where_document: dict | None = None
    metric: str | None = None
    checksum_algorithm: str = "sha256"
    checksum: str = ""

    def __post_init__(self):
        self.vector = np.asarray(self.vector, dtype=np.float32).ravel()
        if self.k < 1:
            raise InvalidRecord("k has to be at least 1")
        if not self.vector.size:
            raise EmptyVector("a query vector needs components")
        if not self.checksum:
            self.checksum = self.computed()

    def computed(self) -> str:
        return digest(request_bytes(self.vector, self.k, self.where, self.where_document), self.checksum_algorithm)

    def validate(self, dim: int | None = None) -> None:
        """Before any rewriting, so a changed request never passes."""
        if self.computed() != self.checksum:
            raise ChecksumMismatch("search request")
        if dim is not None and self.vector.size != dim:
            raise DimensionMismatch(f"query of {self.vector.size} components for a collection of {dim}")


def problems(dim: int | None) -> Column:
    """Why a row of RECORD_TYPE can't be taken, or null. dim: None takes vectors of any length."""
    size, kind = F.size("vector"), F.col("kind")
    meta = F.try_parse_json("metadata")
    nested = F.exists(F.map_values(F.try_variant_get(meta, "$", "map<string,variant>")), lambda v: F.schema_of_variant(v).rlike(r"^(OBJECT|ARRAY<OBJECT)"))
    return (
        F.when(F.col("record_id").isNull(), "no id")
        .when((kind == RECORD) & F.col("vector").isNull(), "no vector")
        .when((kind == RECORD) & ((size != dim) if dim is not None else (size < 1)), "wrong dimension")
        .when((kind == RECORD) & F.col("document").isNull() & F.col("metadata").isNull(), "neither document nor metadata")
        .when((kind == RECORD) & F.col("metadata").isNotNull() & ~F.coalesce(F.schema_of_variant(meta).startswith("OBJECT"), F.lit(False)), "metadata isn't an object")
        .when((kind == RECORD) & nested, "nested metadata")
        .when((kind != RECORD) & (F.col("vector").isNotNull() | F.col("document").isNotNull() | F.col("metadata").isNotNull()), "content without a record")
    )


def split_valid(records: DataFrame, dim: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows that can be taken, and the others with their problem."""
    checked = records.withColumn("problem", problems(dim))
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")
