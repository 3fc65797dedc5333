"""Operators on canonical events: normalize, validate, snapshot, ingest, parity."""
