"""Release-catalogue analytics on Spark DataFrames."""
