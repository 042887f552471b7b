"""barloom streaming."""
