"""Document-similarity and entity analytics on Spark DataFrames."""
