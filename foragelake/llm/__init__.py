"""Operators for building training corpora, each a set of DataFrame transformations."""
