"""Operators on text corpora for language-model training data."""
