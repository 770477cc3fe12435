"""Dataset preparation, read planning and streaming for training data, on Spark DataFrames."""
