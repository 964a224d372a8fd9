"""Column builders: scalar semantics expressed with built-in Spark functions."""
