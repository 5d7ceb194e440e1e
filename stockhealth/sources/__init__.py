"""Readers, writers and data contracts."""
