"""Plans: the role mapping onto the given tables, the feature pipelines per source,
and the registry of named queries with their SQL oracles."""
