"""Analytics for small-molecule discovery data on Spark DataFrames."""

__version__ = "0.1.0"
