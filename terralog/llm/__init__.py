"""Operators for training-text pipelines, each written as Spark jobs over a ``documents`` table."""
