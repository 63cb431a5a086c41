"""Relational operators over DataFrames whose columns are named by field."""
