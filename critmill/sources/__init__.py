"""Readers of terminology files, keyed tables, exports."""
