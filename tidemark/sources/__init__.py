"""Readers and their registry."""
