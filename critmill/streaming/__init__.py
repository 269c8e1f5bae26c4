"""Incremental runs over streams."""
