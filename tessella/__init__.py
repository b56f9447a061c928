"""Versioned, sorted cell tables on Spark: predicates, resolution, stream operators, functions, maintenance."""
