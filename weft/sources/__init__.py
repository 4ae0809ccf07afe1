"""Readers, writers and derivations of graphs."""
