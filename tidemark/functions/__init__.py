"""Column expressions: text, time, type mapping, fingerprints, log parsing."""
