"""tidegrid sources."""
