"""glossweave: analytics over cross-language link graphs, on Spark DataFrames."""
