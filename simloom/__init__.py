"""simloom: similarity, information-theoretic and record analytics on Spark DataFrames."""
