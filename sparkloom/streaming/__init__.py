"""Continuous queries over tables that grow."""
