"""Checks and incidents on streams."""
