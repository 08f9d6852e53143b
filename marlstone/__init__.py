"""Marlstone: evidence retrieval and document analytics on Spark DataFrames."""
