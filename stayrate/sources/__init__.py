"""Readers, extracts, table roles and writers."""
