"""orbitmill: graph-centrality analytics on PySpark DataFrames."""
