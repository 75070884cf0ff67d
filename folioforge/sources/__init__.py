"""Sources of the page-bundle engine."""
