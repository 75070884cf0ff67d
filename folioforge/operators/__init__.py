"""Operators of the page-bundle engine."""
