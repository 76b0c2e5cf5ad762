"""DataFrame operators: extraction, identity, enrichment, predecessor and upsert."""
