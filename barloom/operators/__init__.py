"""Operators of barloom."""
