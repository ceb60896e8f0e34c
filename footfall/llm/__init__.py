"""Operators for large text collections: filtering, near-duplicates, scoring, search and mixing."""
