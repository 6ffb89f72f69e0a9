"""Operators for preparing training data: identification, extraction, tokens, privacy, duplicates, leaks."""
