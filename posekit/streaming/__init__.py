"""Incremental (skip what is done) helpers."""
