"""operators of the web-archive engine."""
