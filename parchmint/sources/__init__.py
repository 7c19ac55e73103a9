"""Readers and writers of the vault's outside world: files, feeds, mail, labels, fetchers."""
