"""Vocabularies, column expressions and exact quantiles shared by the operators."""
