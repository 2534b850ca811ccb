"""Operators for building training corpora: filters, joins, models and tokenizers over whole tables."""
