"""Operators for large text corpora that feed language-model training."""
