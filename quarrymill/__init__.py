"""Corpus curation and graph analytics as DataFrame and Column operations."""
