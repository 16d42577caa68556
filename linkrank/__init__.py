"""linkrank: hybrid document retrieval and analytics on Spark DataFrames."""
