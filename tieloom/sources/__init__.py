"""Reading, building and writing tables."""
