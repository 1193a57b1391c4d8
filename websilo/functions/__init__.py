"""functions of the web-archive engine."""
