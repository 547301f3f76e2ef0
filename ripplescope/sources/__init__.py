"""Readers, record parsers and snapshot tables."""
