"""Readers of tables, fixtures, corpora and mail dumps."""
