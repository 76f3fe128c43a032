"""Column functions: text, vectors, geometry, images."""
