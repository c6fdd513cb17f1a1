"""Operators for preparing training corpora: copies, contamination, toxicity,
secrets, mixtures, token files and chat formatting.

Nothing outside this package imports it.
"""
