"""Corpus operators for training data: one module per operator."""
