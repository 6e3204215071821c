"""Column expressions; no action runs here."""
