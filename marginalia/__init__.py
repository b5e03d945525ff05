"""A PySpark-native analytics engine for document and learning data."""
