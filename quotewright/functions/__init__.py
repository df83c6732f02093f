"""Scalar and aggregate functions with the engine's exact semantics."""
