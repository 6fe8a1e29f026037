"""Sequence identification and corpus analytics on Spark DataFrames."""
