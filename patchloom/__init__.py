"""patchloom: geospatial patch datasets and multilabel evaluation on PySpark.

Operators are plain functions from DataFrames to DataFrames.  Nothing keeps a
global session, and every parameter is a plain value.
"""
