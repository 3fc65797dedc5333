"""Readers of raw files, source discovery and the adapters that map records to canonical events."""
