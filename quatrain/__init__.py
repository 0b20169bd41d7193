"""Verse-corpus analytics as DataFrame operations."""
