"""Spark-native analytics for legislative, election and text-corpus data.

Every public operator takes DataFrames or Columns and returns DataFrames or
Columns; nothing is collected to the driver unless its size is bounded by the
schema (a histogram over fixed bins, a handful of statistics).
"""
