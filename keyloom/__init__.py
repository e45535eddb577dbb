"""Typed-text and corpus analytics on Spark DataFrames."""
