"""Operators for training data at scale. Nothing else in tarnwell imports this package."""
