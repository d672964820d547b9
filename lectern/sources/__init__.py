"""Readers, writers and stored indexes."""
