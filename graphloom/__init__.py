"""A PySpark-native analytics engine for cross-service code graphs."""

__version__ = "0.1.0"
