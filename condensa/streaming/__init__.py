"""Incremental runs of the stateless steps."""
