"""Column functions: boxes, geometry and tolerant scalars."""
