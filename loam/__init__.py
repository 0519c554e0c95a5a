"""loam: knowledge-base and training-corpus jobs on Spark DataFrames."""
