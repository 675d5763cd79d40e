"""Master-data state diff and guarded change engine on Spark DataFrames."""
