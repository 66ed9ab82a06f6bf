"""Operators for building training corpora, each by one distributed method."""
