"""Query languages: modules that turn query text into requests."""

from .lucene import LuceneEngine
from .sql import SqlEngine

__all__ = ["LuceneEngine", "SqlEngine"]
