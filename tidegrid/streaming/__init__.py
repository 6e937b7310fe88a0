"""tidegrid streaming."""
