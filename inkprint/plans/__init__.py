"""Whole attribution methods, composed from the operators."""
