"""Whole plans built from the operators: enrichment, models, metrics and reports."""
