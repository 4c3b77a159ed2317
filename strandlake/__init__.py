"""Long-read sequencing analytics on Spark DataFrames."""
