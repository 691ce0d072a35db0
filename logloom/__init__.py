"""A PySpark-native engine for recorded-activity pipelines."""

__version__ = "0.1.0"
