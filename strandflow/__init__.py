"""Spark-native analytics for mixed genome populations sequenced as short reads."""
