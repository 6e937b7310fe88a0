"""tidegrid plans."""
