"""Readers: landed pages, score sheets of three providers, registry records."""
