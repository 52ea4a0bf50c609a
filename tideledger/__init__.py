"""Event-market analytics on Spark DataFrames."""
