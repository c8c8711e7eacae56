"""Column-expression libraries."""
