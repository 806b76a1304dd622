"""Spark-native engine that turns document collections into a queryable knowledge graph."""
