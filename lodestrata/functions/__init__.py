"""Column functions and closed formulas."""
