"""tabletloom: a PySpark-native engine for parallel text corpora."""

__version__ = "0.1.0"
