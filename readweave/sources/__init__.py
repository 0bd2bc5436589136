"""Readers and writers of reads, positions, pairs and lengths."""
