"""Source-code intelligence and corpus analytics on Spark DataFrames."""
