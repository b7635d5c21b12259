"""Readers, writers and parameter files."""
