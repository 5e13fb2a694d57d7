"""Multi-source record fusion on Spark DataFrames."""
