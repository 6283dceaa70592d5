"""palimpsest: a Spark-native engine for multi-dimensional memory retrieval."""
