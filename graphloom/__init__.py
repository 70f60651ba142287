"""Graph analytics over Spark DataFrames."""
