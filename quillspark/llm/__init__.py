"""Corpus operators for training data: each module holds one operator and the thin query that applies it."""
