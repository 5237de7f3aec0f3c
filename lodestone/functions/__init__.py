"""Types, literals and how values are shown."""
