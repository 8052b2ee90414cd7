"""Event tables: reading, writing, generating; queries by name."""
