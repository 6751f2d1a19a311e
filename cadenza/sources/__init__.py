"""Readers, role views and writers."""
