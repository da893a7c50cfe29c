"""Operators for large training corpora: packing, search, dedup, decontamination, classifiers and token files."""
