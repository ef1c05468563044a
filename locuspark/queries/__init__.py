"""Queries by name over the shared tables, and equivalent SQL for checking them."""
