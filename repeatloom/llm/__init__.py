"""Operators for text corpora. Nothing outside this folder imports it, but for the optional hook of the query list."""
