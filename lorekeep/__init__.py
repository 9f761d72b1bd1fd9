"""lorekeep: text-memory analytics on Spark DataFrames."""
