"""relata: declarative object queries and bulk ingestion as Spark DataFrame plans."""

__version__ = "0.1.0"
