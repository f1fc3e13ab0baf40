"""Operators on sequences and texts for training data. Nothing outside imports this package."""
