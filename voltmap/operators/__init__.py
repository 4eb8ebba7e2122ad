"""DataFrame -> DataFrame operators (normalize, dedup, match, upsert, aggregate)."""
