"""Readers and writers: files, JSON lines, manifests, and changes expressed as new tables."""
