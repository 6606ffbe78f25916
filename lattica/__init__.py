"""Graph analytics, vertex embedding and training-data operators on Spark DataFrames."""
