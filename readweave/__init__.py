"""Overlap analytics on Spark: which reads (or texts) overlap, by sketches, by shared k-mers, by position."""
