"""Road-safety network screening on Spark DataFrames."""
