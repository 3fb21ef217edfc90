"""Operators for large training corpora; nothing else in this library imports them."""
