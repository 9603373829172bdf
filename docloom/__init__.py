"""Document and terminology dataflows on Spark DataFrames."""
