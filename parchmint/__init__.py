"""Parchmint: a document vault's storage, cleaning and search as Spark plans."""
