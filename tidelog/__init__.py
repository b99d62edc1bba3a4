"""tidelog: versioned, ordered key-value analytics expressed as Spark DataFrames."""

from tidelog.store import Store  # noqa: F401

__all__ = ["Store"]
