"""Column functions and reusable relational patterns."""
