"""docmill: a PySpark-native engine for document analytics and data preparation."""

__version__ = "0.1.0"
