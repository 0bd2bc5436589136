"""Relational operators: signatures, bands, joins, comparison."""
