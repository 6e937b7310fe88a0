"""tidegrid functions."""
