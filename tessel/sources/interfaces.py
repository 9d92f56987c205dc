"""What the parts of a store have to offer, for code that works with others of the same shape."""

from collections.abc import Iterable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from ..schema import CollectionSchema, Record, SearchRequest


@runtime_checkable
class Changes(Protocol):
    """A log of changes that is folded into a state."""

    def write(self, changes: DataFrame, base_lsn: int | None = None, reads: Iterable[str] = ()) -> DataFrame: ...
    def read(self, mode: str = "latest", as_of: int | None = None, lag_bound: int | None = None, min_lsn: int | None = None, keys: DataFrame | None = None) -> DataFrame: ...
    def max_lsn(self) -> int: ...
    def flush(self) -> int: ...
    def compact(self) -> None: ...


@runtime_checkable
class Records(Protocol):
    """Records by id."""

    def insert(self, records: Iterable[Record], base_lsn: int | None = None, reads: Iterable[str] = ()) -> list[Record]: ...
    def delete(self, ids: Iterable[str], base_lsn: int | None = None, reads: Iterable[str] = ()) -> list[Record]: ...
    def get(self, record_id: str) -> Record: ...
    def ids(self) -> DataFrame: ...


@runtime_checkable
class Searchable(Protocol):
    """Nearest records and the tables that documents are found by."""

    def search(self, request: SearchRequest, mode: str = "latest", strategy: str = "exact") -> DataFrame: ...
    def search_batch(self, queries: DataFrame, k: int, metric: str | None = None) -> DataFrame: ...
    def terms(self) -> DataFrame: ...
    def fields(self) -> DataFrame: ...


@runtime_checkable
class Collections(Protocol):
    """Collections by name."""

    def create_collection(self, schema: CollectionSchema) -> Records: ...
    def collection(self, name: str) -> Records: ...
    def list_collections(self) -> list[str]: ...
    def drop_collection(self, name: str) -> CollectionSchema | None: ...
