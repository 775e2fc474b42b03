"""docgrove: documentation retrieval and corpus processing on Spark DataFrames."""
