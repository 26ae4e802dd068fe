"""Keyspan: keyed documents, graphs and logs on Spark DataFrames."""
