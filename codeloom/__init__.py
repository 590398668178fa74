"""Code-graph and corpus analytics on Spark DataFrames."""
