"""Grouped-sequence analytics on Spark.

A row is one position of one group, measured under one condition. Every operator
takes DataFrames and returns a DataFrame; only fitted constants of a fixed size
(bin edges, fill values, hash cut points) ever reach the driver.
"""
