"""Operators for preparing training data: vectors, texts, captions and token streams."""
