"""Readers, writers and landed-file helpers."""
