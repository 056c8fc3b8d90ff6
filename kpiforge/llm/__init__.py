"""Operators for training-data pipelines over text, embedding and label tables."""
