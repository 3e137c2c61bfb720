"""Column functions: URLs, hashes, scores."""
