"""Incremental versions of the ticket counts and the last activity."""
