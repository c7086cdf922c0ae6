"""Motion-and-speech session analytics on Spark DataFrames."""
