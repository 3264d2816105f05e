"""A Spark-native engine that mines document collections into an evidence-backed entity graph."""
