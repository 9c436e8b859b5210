"""Operators for language-model data; nothing else in the library imports them."""
