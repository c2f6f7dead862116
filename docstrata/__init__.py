"""Document-intelligence analytics expressed as Spark DataFrames."""
