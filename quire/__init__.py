"""quire: manuscript analytics on Spark DataFrames."""
