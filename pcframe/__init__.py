"""pcframe: a PySpark-native engine for batched 3-D point-cloud analytics."""

__version__ = "0.1.0"
