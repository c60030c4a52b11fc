"""Column expressions: quaternions, coordinates, pixels."""
