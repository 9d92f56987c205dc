"""Vector collections, filtered nearest-neighbour search and versioned change logs on Spark DataFrames."""
