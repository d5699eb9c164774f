"""Relational operators of the access-control pipeline."""
