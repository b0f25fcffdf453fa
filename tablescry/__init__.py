"""Spark-native table profiling, quality audit, repair and insight operators."""
