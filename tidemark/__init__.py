"""Catalog drift and package-artifact analysis on Spark DataFrames."""

__version__ = "0.1.0"
