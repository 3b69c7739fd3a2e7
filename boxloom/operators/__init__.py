"""boxloom: relational operators."""
