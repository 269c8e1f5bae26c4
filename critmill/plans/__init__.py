"""Bindings on the test tables, registered queries, the batch plan."""
