"""Readers and writers; libraries that may be absent are imported only when a source runs."""
