"""Operators for training data: co-occurrence, token ids, mixing, splitting."""
