"""Whole queries and reports, built from the operators."""
