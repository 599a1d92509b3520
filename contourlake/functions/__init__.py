"""Column functions: colours, numbers, geometry and settings."""
