"""barloom plans."""
