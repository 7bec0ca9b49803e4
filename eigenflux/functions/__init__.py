"""Scalar and small-vector functions."""
