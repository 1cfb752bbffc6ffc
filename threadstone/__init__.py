"""Threadstone: a PySpark engine for code-context retrieval, graphs, memories and the data work around them."""

__version__ = "0.1.0"
