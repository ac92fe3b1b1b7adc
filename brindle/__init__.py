"""Catalog, search, graph, log and text analytics on PySpark DataFrames."""
