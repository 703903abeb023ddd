"""The monitoring plan on arriving data."""
