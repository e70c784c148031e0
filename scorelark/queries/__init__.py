"""Registered queries, by area."""
