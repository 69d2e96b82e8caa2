"""Whole plans: an index over vectors, and the library's queries."""
