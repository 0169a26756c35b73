"""Keyed state over streams."""
