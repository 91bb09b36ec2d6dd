"""Scalar functions: Column expressions, and the few text routines Spark lacks."""
