"""Readers that put tables into the annotated-matrix model."""
