"""searchlake: web-search analytics on Spark DataFrames."""
