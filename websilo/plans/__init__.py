"""plans of the web-archive engine."""
