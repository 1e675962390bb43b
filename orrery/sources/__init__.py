"""Reading and normalising records."""
