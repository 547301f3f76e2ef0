"""Operators for preparing training text: scoring, joins, filters, scans, tokens."""
