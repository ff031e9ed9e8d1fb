"""Named trend queries, fixture derivation from the bench tables, and the query catalogue."""
