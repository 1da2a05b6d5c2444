"""Lookups, indexes, joins and summaries over DataFrames of alignment records."""
