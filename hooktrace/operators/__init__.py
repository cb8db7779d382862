"""DataFrame operators: filters, pages, counts, upserts, lookups, screening."""
