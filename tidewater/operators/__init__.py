"""Relational, document, search, mutation, merge and key-value operators over DataFrames."""
