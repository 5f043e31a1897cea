"""Labelled-text classification and its evaluation as Spark jobs."""

__version__ = "0.1.0"
