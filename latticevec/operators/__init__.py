"""Operators over tables of vectors."""
