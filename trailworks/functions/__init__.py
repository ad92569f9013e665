"""Column functions: everything here is a Catalyst expression, no Python UDF in the hot path."""
