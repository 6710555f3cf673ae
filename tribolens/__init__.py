"""Equipment-condition analytics on Spark DataFrames."""
