"""Clause, obligation and text analytics built on Spark DataFrames."""
