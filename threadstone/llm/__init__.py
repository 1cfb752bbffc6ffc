"""Operators for training data: tokenising, mixing, reading levels, documentation pairs, credentials."""
