"""Derived input tables, the named query library and its SQL oracles."""
