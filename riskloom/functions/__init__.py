"""Scalar and array column functions."""
