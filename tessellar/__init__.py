"""A Spark-native engine for multi-camera event streams and training data."""
