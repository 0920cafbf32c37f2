"""Readers, writers and published relations."""
