"""Lodeline: corpus retrieval, provenance and evaluation analytics on Spark DataFrames."""
