"""spanloom: interval and time-series evidence operators over Spark DataFrames."""

__version__ = "0.1.0"
