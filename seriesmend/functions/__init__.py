"""Column-level building blocks: NaN-domain arithmetic and formulas."""
