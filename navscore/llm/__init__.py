"""Operators that prepare text corpora for training: rules, models, dedup, tokens, files."""
