"""Logical specifications, the SQL front end, plan texts and metrics."""
