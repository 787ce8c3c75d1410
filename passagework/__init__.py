"""Batch retrieval and question answering over document tables, on Spark DataFrames."""
