"""Continuous upkeep: change logs into indexes, debounced file events, mail drops."""
