"""Training-data operators on Spark DataFrames."""
