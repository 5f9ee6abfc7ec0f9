"""navspark: ranked definition lookup and training-data operators on Spark DataFrames."""
