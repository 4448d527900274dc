"""Expressions over document fields as Spark columns."""
