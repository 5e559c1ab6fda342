"""Spark-native log reduction and corpus operators."""
