"""sources of the web-archive engine."""
