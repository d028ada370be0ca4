"""Column expressions: text, CSV, JSON and XML rendering, and strict parsing."""
