"""Tabular and document-quality analytics on Spark DataFrames."""
