"""Operators as Spark columns and frames."""
