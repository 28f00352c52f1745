"""vecgrove: a Spark-native cluster-pruning vector search engine."""
