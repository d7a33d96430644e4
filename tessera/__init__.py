"""tessera: knowledge-graph analytics on Spark DataFrames."""
