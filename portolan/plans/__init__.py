"""Composed queries and the catalog that __spark_entry__ registers."""
