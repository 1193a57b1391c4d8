"""streaming of the web-archive engine."""
