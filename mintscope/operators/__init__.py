"""Relational operators: quality, aggregation, windows, joins, graphs and ledgers."""
