"""Derived tables and the queries over them."""
