"""Feeds, board pages and table snapshots."""
