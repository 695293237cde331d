"""Readers, writers and the derived fact tables."""
