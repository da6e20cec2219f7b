"""Scalar functions: codecs, names, checksums, filters, replies."""
