"""Scene analytics on Spark DataFrames."""
