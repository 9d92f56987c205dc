"""Records as bytes and as JSON, for exchange with stores that hold one record at a time."""

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ChecksumMismatch, InvalidRecord
from ..functions.checksums import array_from_wire, array_to_wire
from ..schema import RECORD, Record

# Fixed values of the binary record format: magic bytes, version, and the header (magic, version, five lengths).
MAGIC = b"VCRD"
VERSION = 1
HEADER = struct.Struct("<4s B 5I")


def to_bytes(record: Record) -> bytes:
    """Header, then id, document (JSON), float32 components, metadata (JSON) and checksum."""
    if record.kind != RECORD:
        raise InvalidRecord("only records have a binary form")
    as_json = lambda x: b"" if x is None else json.dumps(x).encode()
    parts = [record.record_id.encode(), as_json(record.document), record.vector.astype("<f4").tobytes(), as_json(record.metadata), record.checksum.encode()]
    return HEADER.pack(MAGIC, VERSION, *map(len, parts)) + b"".join(parts)


def from_bytes(data: bytes, checksum_algorithm: str = "sha256") -> Record:
    """The record, checked against its checksum."""
    if len(data) < HEADER.size:
        raise InvalidRecord("shorter than a header")
    magic, version, *sizes = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise InvalidRecord(f"not a record of version {VERSION}")
    if len(data) < HEADER.size + sum(sizes):
        raise InvalidRecord("shorter than its header says")
    ends = np.cumsum([HEADER.size, *sizes]).tolist()
    name, document, vector, metadata, checksum = (data[a:b] for a, b in zip(ends, ends[1:], strict=False))
    record = Record(
        name.decode(), np.frombuffer(vector, dtype="<f4"), json.loads(document) if document else None, json.loads(metadata) if metadata else None, checksum_algorithm=checksum_algorithm
    )
    if record.checksum != checksum.decode():
        raise ChecksumMismatch(record.record_id)
    return record


def size_of(data: bytes) -> int:
    """Bytes of the record at the start of data."""
    return HEADER.size + sum(HEADER.unpack_from(data)[2:])


def to_dict(record: Record) -> dict:
    vector = None if record.vector is None else array_to_wire(record.vector)
    return {
        "type": record.kind, "record_id": record.record_id, "original_data": record.document, "vector": vector, "metadata": record.metadata,
        "checksum_algorithm": record.checksum_algorithm, "checksum": record.checksum,
    }


def from_dict(d: dict) -> Record:
    vector = None if d.get("vector") is None else array_from_wire(d["vector"])
    record = Record(d["record_id"], vector, d.get("original_data"), d.get("metadata"), d["type"], d.get("checksum_algorithm", "sha256"))
    if d.get("checksum") and d["checksum"] != record.checksum:
        raise ChecksumMismatch(record.record_id)
    return record


def encoded(row: Column) -> Column:
    """BINARY of a struct of RECORD_TYPE."""

    @F.pandas_udf("binary")
    def encode(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([to_bytes(Record.from_row(r)) for r in rows.itertuples(index=False)])

    return encode(row)


def decoded(data: Column) -> Column:
    """A struct of RECORD_TYPE from BINARY; a damaged row fails its task."""
    kind = "record_id string, kind string, vector array<float>, document string, document_is_text boolean, metadata string, checksum string, checksum_algorithm string"

    @F.pandas_udf(kind)
    def decode(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([from_bytes(bytes(v)).row() for v in values], columns=[c.split()[0] for c in kind.split(", ")])

    return decode(data)
