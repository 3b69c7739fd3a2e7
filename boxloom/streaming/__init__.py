"""boxloom: streaming."""
