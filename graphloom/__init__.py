"""Property-graph processing and data preparation on Spark DataFrames."""
