"""Spark-native preparation and evaluation of text pairs: sources, text functions, metrics, rankings, rewards."""
