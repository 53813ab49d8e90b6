"""lorewell: a PySpark-native engine for document knowledge corpora."""
