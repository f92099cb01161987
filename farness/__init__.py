"""farness: exact closeness analytics on Spark DataFrames."""
