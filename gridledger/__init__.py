"""Position-report analytics on Spark DataFrames."""
