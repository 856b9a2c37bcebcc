"""Readers, schema discovery and writers."""
