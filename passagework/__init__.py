"""passagework: grounded document question answering and corpus preparation on Spark DataFrames."""
