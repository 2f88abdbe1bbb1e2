"""Column-expression helpers (text, higher-order array functions)."""
