"""Relational operators over DataFrames; each returns a lazy plan for Catalyst to optimise."""
