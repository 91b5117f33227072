"""Evaluation metrics as aggregations."""
