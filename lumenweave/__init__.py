"""lumenweave: a Spark-native engine for evidence-bearing document data."""
