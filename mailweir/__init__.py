"""mailweir: mail-corpus analytics on Spark DataFrames."""
