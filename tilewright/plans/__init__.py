"""Jobs composed of the operators, and the query registry."""
