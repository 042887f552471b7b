"""barloom ml."""
