"""helixmill: repeat and match analytics over string collections, on Spark DataFrames."""
