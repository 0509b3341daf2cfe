"""Stateful jobs: claims from fragments as they arrive, and course files as they appear."""
