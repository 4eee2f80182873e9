"""Scalar functions and fixed values."""
