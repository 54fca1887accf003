"""Operators for training-data pipelines over document, conversation and vector tables."""
