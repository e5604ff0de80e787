"""State-interval analytics on Spark DataFrames."""
