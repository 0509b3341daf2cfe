"""Readers of course files and event streams."""
