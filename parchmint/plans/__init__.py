"""Whole queries: the engine's methods and the registered queries."""
