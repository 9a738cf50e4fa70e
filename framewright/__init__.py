"""Time-aligned token streams and their metrics on Spark DataFrames."""
