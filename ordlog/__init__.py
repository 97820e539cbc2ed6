"""Ordered, versioned key-value data as Spark DataFrames."""
