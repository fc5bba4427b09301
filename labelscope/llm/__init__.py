"""Operators for training data: tokens, quality, privacy, duplicates, search, mixing, archives."""
