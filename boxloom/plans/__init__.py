"""boxloom: plans."""
