"""loadweave: a Spark-native engine for regional load analytics."""
