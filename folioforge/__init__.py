"""folioforge: a PySpark-native analytics engine for text corpora."""
