"""Column helpers: URLs, hosts, time, JSON text and HTML elements."""
