"""Functions of the page-bundle engine."""
