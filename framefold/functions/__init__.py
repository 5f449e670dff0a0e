"""Scalar rules and array expressions."""
