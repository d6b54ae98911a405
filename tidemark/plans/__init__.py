"""What to do per table, decided from configuration and metadata tables."""
