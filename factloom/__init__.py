"""Spark-native code-intelligence analytics over columnar fact tables."""
