"""Queries over the driver's tables, and the checked query surface."""
