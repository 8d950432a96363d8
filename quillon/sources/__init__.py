"""Readers, writers and checks."""
