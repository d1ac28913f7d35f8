"""Operators for training data: sampling, mixing, collapsing, counting, encoding, packing, redaction."""
