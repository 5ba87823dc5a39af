"""Work-time analytics and tabulation on Spark DataFrames."""

__version__ = "0.1.0"
