"""Readers, writers and stand-in relations."""
