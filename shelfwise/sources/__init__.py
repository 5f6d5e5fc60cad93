"""Readers, feed parsers and writers."""
