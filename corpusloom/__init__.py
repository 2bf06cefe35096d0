"""Corpus, retrieval and telemetry operators on Spark DataFrames."""
