"""A Spark-native engine for multi-channel event signals."""
