"""Code-corpus analytics on Spark DataFrames."""
