"""Checksums of bytes and records, and the canonical text that they are taken of."""

import base64
import hashlib
import json
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRecord

Algorithm = str | Callable[[bytes], str]


def canonical(value) -> str:
    """JSON with sorted keys and escapes beyond ASCII, or repr() of what JSON can't hold."""
    try:
        return json.dumps(value, sort_keys=True)
    except (TypeError, ValueError):
        return repr(value)


def digest(data: bytes, algorithm: Algorithm = "sha256") -> str:
    if callable(algorithm):
        return algorithm(data)
    name = algorithm.lower()
    if name == "crc32":
        return f"{zlib.crc32(data):08x}"
    try:
        return hashlib.new(name, data).hexdigest()
    except ValueError as e:
        raise InvalidRecord(f"unknown checksum algorithm {algorithm}") from e


def column_digest(data: Column, algorithm: Algorithm = "sha256") -> Column:
    """Of a string or binary column; the common algorithms run in the JVM, all others in a pandas UDF."""
    name = algorithm if callable(algorithm) else algorithm.lower()
    sizes = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}
    if name == "crc32":
        return F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0")
    if name == "md5":
        return F.md5(data)
    if name == "sha1":
        return F.sha1(data)
    if name in sizes:
        return F.sha2(data, sizes[name])
    digest(b"", algorithm)  # an unknown name fails here, not in a task

    @F.pandas_udf("string")
    def other(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else digest(bytes(x), algorithm))

    return other(data.cast("binary"))


def record_digest(row: Column) -> Column:
    """The checksum of a struct of the columns of records, by its own algorithm."""

    @F.pandas_udf("string")
    def of(rows: pd.DataFrame) -> pd.Series:
        out = []
        for r in rows.itertuples(index=False):
            document = r.document if r.document is None or r.document_is_text else json.loads(r.document)
            out.append(digest(record_bytes(r.kind, r.record_id, document, r.vector, None if r.metadata is None else json.loads(r.metadata)), r.checksum_algorithm or "sha256"))
        return pd.Series(out)

    return of(row)


# Fixed values of the record format: the order of the parts, "null" for what isn't there, float32 in little-endian order.
def record_bytes(kind: str, record_id: str, document, vector, metadata) -> bytes:
    """What a record's checksum covers: kind, id, document, float32 components and metadata, null for what isn't there."""
    parts = [kind.encode(), record_id.encode()]
    parts.append(b"null" if document is None else canonical(document).encode())
    parts.append(b"null" if vector is None else np.asarray(vector, dtype="<f4").tobytes())
    parts.append(b"null" if metadata is None else canonical(metadata).encode())
    return b"".join(parts)


def request_bytes(vector, k: int, where: dict | None, where_document: dict | None) -> bytes:
    """What a search request's checksum covers."""
    return np.asarray(vector, dtype="<f4").tobytes() + "".join(canonical(x) for x in (k, where or {}, where_document or {})).encode()


def result_digest(record_checksum: str, distance: float, algorithm: Algorithm = "sha256") -> str:
    """A search result's checksum is chained to the record's."""
    return digest(record_checksum.encode() + canonical(distance).encode(), algorithm)


def vector_wire(vector: Column) -> Column:
    """Struct (b64, dtype, shape) of an array<float>."""

    @F.pandas_udf("b64 string, dtype string, shape array<int>")
    def encode(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([array_to_wire(np.asarray(v, dtype=np.float32)) if v is not None else {"b64": None, "dtype": None, "shape": None} for v in values])

    return encode(vector)


# Fixed values of the wire form of arrays: the names b64, dtype and shape.
def array_to_wire(a: np.ndarray) -> dict:
    """An array as base64 text, dtype and shape."""
    return {"b64": base64.b64encode(a.tobytes()).decode("ascii"), "dtype": str(a.dtype), "shape": list(a.shape)}


def array_from_wire(wire: dict) -> np.ndarray:
    return np.frombuffer(base64.b64decode(wire["b64"]), dtype=np.dtype(wire["dtype"])).reshape(wire["shape"])


def wire_vector(wire: Column) -> Column:
    """array<float> from a struct (b64, dtype, shape), of any numpy dtype."""

    @F.pandas_udf("array<float>")
    def decode(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if b is None else array_from_wire({"b64": b, "dtype": d, "shape": [-1]}).astype("f4") for b, d in zip(rows["b64"], rows["dtype"], strict=True)])

    return decode(wire)
