"""Streaming of the page-bundle engine."""
