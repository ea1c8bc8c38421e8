"""Lectern: a parallel-text analytics engine expressed in Spark DataFrames."""
