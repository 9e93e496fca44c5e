"""Readers, the source manifest, the extraction cache, and writers."""
