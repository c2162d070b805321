"""Matching, scoring and transforming of form-like documents with Spark DataFrames."""
