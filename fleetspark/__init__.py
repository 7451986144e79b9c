"""Fleet sensor analytics on Spark DataFrames."""
