"""Exceptions of the engine."""

from __future__ import annotations


class TidemarkError(Exception):
    """Base of all errors that this package raises."""


class ValidationError(TidemarkError):
    """A record or argument breaks a rule."""


class TimestampParseError(TidemarkError):
    """A timestamp string or date can't be read."""


class InvalidQueryRangeError(TidemarkError):
    """A time range ends before it starts."""


class ConfigurationError(TidemarkError):
    """A datastore configuration is not usable."""


class UnsupportedBackendError(TidemarkError):
    """A storage location that this engine doesn't offer."""


class ClosedDatastoreError(TidemarkError):
    """An operation on a closed datastore."""


class RecordNotFoundError(TidemarkError):
    """No record has the given id."""


class StorageEngineError(TidemarkError):
    """Storage failed."""


class DatabaseLockedError(StorageEngineError):
    """Another writer holds the file's lock."""


class BinaryFormatError(StorageEngineError):
    """The pointer file is not one of this engine."""


class PageCorruptionError(StorageEngineError):
    """Stored data is missing or contradicts the pointer file."""


class IndexCorruptionError(StorageEngineError):
    """Insertion orders are not unique."""


class QuotaExceededError(TidemarkError):
    """A record doesn't fit into the configured capacity."""


class QueryParseError(TidemarkError):
    """Query text is not well formed."""


class QueryValidationError(TidemarkError):
    """A query breaks a rule or a budget."""


class UnsupportedQueryFeatureError(TidemarkError):
    """A query asks for a feature outside the supported subset."""


class QueryEngineNotRegisteredError(TidemarkError):
    """No query engine is registered for the language."""
