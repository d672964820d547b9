"""Passage retrieval, answer selection and corpus preparation on Spark DataFrames."""
