"""Plans of the page-bundle engine."""
