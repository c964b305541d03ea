"""Readers of feeds, tables and snapshots."""
