"""Folds over unbounded events."""
