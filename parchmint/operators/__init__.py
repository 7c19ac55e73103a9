"""Relational operators of the vault."""
