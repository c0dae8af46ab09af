"""Operators for training-data pipelines over ``documents``, ``embeddings`` and ``conversations``.

Nothing else in the library imports this subpackage.
"""
