"""Skeinery: a PySpark-native engine for crawled web content.

Pages go from capture through validation, cleaning, chunking and indexing to
full-text, vector and hybrid search; everything is declared as DataFrame plans.
"""

__version__ = "0.1.0"
