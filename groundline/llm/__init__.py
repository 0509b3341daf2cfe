"""Operators that prepare training text; no other part of the library imports this subpackage."""
