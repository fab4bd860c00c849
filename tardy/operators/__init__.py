"""Relational operators over the trip table (clean, stats, enrich, explore)."""
