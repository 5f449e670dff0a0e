"""Readers and writers: game recordings, JSON lines, label tables."""
