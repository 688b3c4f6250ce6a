"""Insider-risk analytics as Spark DataFrames and streams."""
