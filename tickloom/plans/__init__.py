"""Registered queries and composed workflows."""
