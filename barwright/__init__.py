"""barwright: ordered price/volume series analytics on Spark DataFrames."""
