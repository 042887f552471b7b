"""barloom sim."""
