"""Operators for matching, canonical naming and text corpora; nothing outside imports them."""
