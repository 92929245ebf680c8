"""Readers of files and lists of queries."""
