"""Views of the input tables, and the catalogue of queries."""
