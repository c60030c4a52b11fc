"""Composite plans and the registered queries."""
