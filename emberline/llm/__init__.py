"""Operators for preparing text and interaction data for training."""
