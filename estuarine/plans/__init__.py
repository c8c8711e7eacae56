"""Composed multi-operator plans."""
