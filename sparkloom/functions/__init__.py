"""Expressions and functions."""
