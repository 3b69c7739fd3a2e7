"""boxloom: sources."""
