"""Factloom: code facts, text search, graph queries and refresh over Spark DataFrames."""
