"""Column expressions: text, typed parsing, evidence phrases, JSON payloads."""
