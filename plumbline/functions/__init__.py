"""Column expressions and schema helpers used by the operators."""
