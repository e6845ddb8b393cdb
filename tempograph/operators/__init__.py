"""Relational, graph, temporal, statistical and evaluation operators on DataFrames."""
