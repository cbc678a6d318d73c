"""Operators that prepare text and vectors for training, each usable on its own."""
