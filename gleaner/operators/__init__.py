"""Operators on pages, blocks, features, labels and models."""
