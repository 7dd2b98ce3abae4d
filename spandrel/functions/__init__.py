"""Column functions: text and units, geometry, designations."""
