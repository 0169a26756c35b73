"""Relational operators with the semantics of labelled tables."""
