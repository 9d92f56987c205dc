"""Operators for training-data pipelines: cleaning, search, counting, encoding and formatting of large corpora."""
