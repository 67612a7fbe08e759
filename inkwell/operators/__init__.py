"""Relational operators of the corpus model."""
