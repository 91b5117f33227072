"""kgspark: a PySpark-native engine for personal knowledge graphs."""

__version__ = "0.1.0"
