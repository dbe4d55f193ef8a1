"""Spark-native document corpus engine: ingest, store, retrieval and statistics as DataFrame plans."""
