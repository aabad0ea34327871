"""The row and group-by part of queries over streaming DataFrames."""
