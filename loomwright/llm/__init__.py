"""Operators for building large-scale training corpora; nothing outside this package imports it."""
