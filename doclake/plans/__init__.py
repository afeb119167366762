"""Whole conversions, from sources to results and chunks."""
