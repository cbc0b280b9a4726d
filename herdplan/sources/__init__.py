"""Readers, writers and generators of panels."""
