"""Finds leaked credentials in text at scale, on Spark DataFrames."""

__version__ = "0.2.0"
