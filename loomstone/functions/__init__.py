"""Column functions: text, time, JSON text and redaction."""
