"""quarry: document retrieval, answer verification and corpus preparation on Spark DataFrames."""
