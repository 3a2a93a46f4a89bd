"""DataFrame operators: joins, merges, windows and aggregations."""
