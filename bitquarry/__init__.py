"""Codelength structure mining and relational operators on Spark DataFrames."""
