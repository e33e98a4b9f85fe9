"""Scalar building blocks, all plain Column expressions."""
