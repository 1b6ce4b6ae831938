"""Operators of a training-data pipeline: language, quality, duplicates, contamination, toxicity, pages, tokens, search."""
