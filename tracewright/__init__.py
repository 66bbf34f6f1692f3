"""tracewright: distributed trace analytics on Spark DataFrames."""
