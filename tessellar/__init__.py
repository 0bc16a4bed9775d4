"""Tessellar: structural index, work tracking and corpus operators as Spark DataFrame plans."""

__version__ = "0.1.0"
