"""Whole programs, composed from the operators."""
