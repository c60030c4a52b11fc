"""Operators on samples, ranges and intervals."""
