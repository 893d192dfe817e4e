"""Operators over annotated matrices."""
