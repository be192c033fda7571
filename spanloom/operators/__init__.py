"""Operators of the knowledge graph, each a function of DataFrames."""
