"""Readers, writers and the declared data contracts."""
