"""Polygenic-trait populations, genealogies and their statistics as Spark DataFrames."""
