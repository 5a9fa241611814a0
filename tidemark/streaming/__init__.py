"""Continuous ingest."""

from .ingest import continuous_append, continuous_turnover

__all__ = ["continuous_append", "continuous_turnover"]
