"""Conversational analytics on Spark.

Messages are read from files or application tables, upserted into versioned Parquet
tables, cut into chunks and windows, tied by replies, and searched by keyword, BM25
and vectors.  Every operator is a function from DataFrames to DataFrames.
"""
