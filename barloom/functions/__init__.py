"""barloom functions."""
