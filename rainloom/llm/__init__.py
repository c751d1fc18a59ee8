"""Operators for preparing training text: scoring, matching, encoding, sharding and mixing of documents."""
