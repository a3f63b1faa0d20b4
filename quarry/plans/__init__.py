"""Composite queries and the registered checks."""
