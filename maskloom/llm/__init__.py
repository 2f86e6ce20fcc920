"""Operators for training-data corpora: tables ``documents``, ``pages``, ``benchmark``, ``labels``."""
