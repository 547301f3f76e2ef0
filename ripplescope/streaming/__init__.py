"""Batching and state over change events."""
