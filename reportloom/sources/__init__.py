"""Readers, writers and path conventions."""
