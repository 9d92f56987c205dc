"""What can go wrong, as exceptions of the engine's own."""


class EngineError(Exception):
    """Base of all errors of this package."""


class InvalidRecord(EngineError, ValueError):
    """A record, filter or request breaks the data model."""


class DimensionMismatch(InvalidRecord):
    """A vector's length differs from the collection's."""


class EmptyVector(InvalidRecord):
    """A vector is null or has no components."""


class UnsupportedMetric(InvalidRecord):
    """A metric other than l2, ip and cosine."""


class ChecksumMismatch(EngineError):
    """Stored and computed checksums differ."""


class RecordNotFound(EngineError, KeyError):
    """No live record has this id."""


class CollectionNotFound(EngineError, KeyError):
    """No collection has this name."""


class CollectionExists(EngineError):
    """A collection of this name exists."""


class WriteConflict(EngineError):
    """Another writer committed one of the records to be written."""


class ReadWriteConflict(EngineError):
    """Another writer committed one of the records that were read."""


class StorageError(EngineError):
    """Stored state can't be read or written."""


class ProjectionError(EngineError):
    """A two-dimensional projection can't be made."""
