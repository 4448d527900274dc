"""Statements: text, tree, and compilation to DataFrames."""
