"""Dashboard rollups composed from the operators."""
