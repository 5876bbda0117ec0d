"""Reconcile, version and map published tables with Spark DataFrames."""
