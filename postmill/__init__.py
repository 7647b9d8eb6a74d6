"""Labelled text-corpus preparation, audit, split, classification and evaluation on Spark.

Every operator takes DataFrames and returns DataFrames.  No module opens a
session; callers pass one in or it is taken from the input frame.
"""
