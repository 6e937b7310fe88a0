"""tidegrid operators."""
