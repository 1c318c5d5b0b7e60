"""Relational operators on frames."""
