"""Relational operators of the language, from specification objects to DataFrames."""
