"""Scoring narratives as they arrive."""
