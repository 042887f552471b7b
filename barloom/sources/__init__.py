"""barloom sources."""
