"""Spatio-temporal anomaly analytics on Spark DataFrames."""
