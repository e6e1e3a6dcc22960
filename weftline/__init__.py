"""weftline: document segments, quality checks, licensing and job analytics on Spark DataFrames."""
