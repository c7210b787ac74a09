"""Set-at-a-time document matching and evaluation on Spark DataFrames."""
