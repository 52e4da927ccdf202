"""Operators over DataFrames: search, spelling, keywords, duplicates, hierarchy and lifecycle."""
