"""Operators for training data: nearest-time pairing, mergeable percentiles, tokenising, mixing, subjects."""
