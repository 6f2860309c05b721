"""Layerloom: declarative, typed data pipelines compiled to Spark DataFrames."""

__version__ = "0.1.0"
