"""Reading and writing datasets, and parsers of feed formats."""
