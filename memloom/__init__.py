"""memloom: agent-memory analytics on Spark DataFrames."""
