"""Spark jobs for recommendation data: profiles, samples, events, retrieval, metrics."""

__version__ = "0.1.0"
