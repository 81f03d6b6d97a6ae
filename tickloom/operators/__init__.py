"""Operators on long-format tables, each a function from DataFrame to DataFrame."""
