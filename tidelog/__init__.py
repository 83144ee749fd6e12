"""A Spark-native engine for keyed change logs."""
