"""Scans of digests, pages, captions and event streams."""
