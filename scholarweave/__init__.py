"""scholarweave: literature knowledge graphs and graph retrieval on Spark DataFrames."""

__version__ = "0.1.0"
