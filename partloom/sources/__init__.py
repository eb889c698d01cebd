"""Readers and writers for product files, spec files and the catalogue tables."""
