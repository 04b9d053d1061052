"""Operators for preparing training corpora, one module per method."""
