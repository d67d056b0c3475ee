"""Operators for building training corpora: chat formatting, URL and quality
filters, toxicity, deduplication, mixing, personal data, packing and
repetition.  Nothing outside this package imports it."""
