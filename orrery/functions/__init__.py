"""Column helpers: text keys, scores."""
