"""Page-level text features at corpus scale, on Spark DataFrames."""
