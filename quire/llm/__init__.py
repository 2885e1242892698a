"""Operators for the preparation of training data for language models."""
