"""Catalog snapshots that arrive as files."""
