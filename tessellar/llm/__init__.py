"""Operators for text that language models are trained on."""
