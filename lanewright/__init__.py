"""Street-coverage analytics on Spark DataFrames."""
