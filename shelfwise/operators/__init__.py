"""Catalogue operators: merge, search, baskets, reports, gates."""
