"""Column functions and vectorised parsers."""
