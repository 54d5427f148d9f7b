"""Operators that prepare text corpora for training language models."""
