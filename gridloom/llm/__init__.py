"""Operators for text corpora: encoding, packing and quality statistics. Nothing outside imports this subpackage."""
