"""Graph, vector and solver operators over DataFrames."""
