"""A PySpark-native analytics engine for parallel-text corpora."""
