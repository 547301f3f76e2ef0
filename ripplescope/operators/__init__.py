"""Joins, graph walks, evidence folds and rollups."""
