"""A strictly typed analytical SQL engine that compiles to Spark DataFrames."""

__version__ = "0.1.0"
