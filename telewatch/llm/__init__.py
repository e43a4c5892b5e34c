"""Operators of a pipeline that prepares training text for language models.

Nothing else in the library imports this package. Every operator takes plain DataFrames; `queries` registers one query
per operator over the tables `documents`, `pages`, `benchmark` and `labels`.
"""
