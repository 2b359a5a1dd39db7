"""Training-data operators: scoring, labelling, masking, matching and deduplication of documents.

Nothing outside this subpackage imports it.
"""
