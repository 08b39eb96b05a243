"""Stores and text sources: snapshots, upserts, restore with defaults, section headers."""
