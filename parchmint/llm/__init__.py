"""Preparation of training data from a vault's documents; nothing else in the library needs it."""
