"""Operators for text training data; nothing else in the library imports this package.

Sizes are tokens of a byte-level tokenizer: one for each UTF-8 byte.
"""
