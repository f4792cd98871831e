"""A Spark-native engine for code and text similarity."""
