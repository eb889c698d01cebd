"""partloom: parts-catalogue analytics on Spark DataFrames."""
