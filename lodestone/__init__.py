"""A PySpark engine for retrieval over, and replication of, short text records."""

__version__ = "0.1.0"
