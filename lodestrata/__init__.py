"""Spark-native analytics over documents, API symbols and code examples."""
