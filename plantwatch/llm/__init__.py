"""Operators for training data: documents and web pages to deduplicated, scored, mixed and tokenized text."""
