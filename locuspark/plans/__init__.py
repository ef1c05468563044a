"""Plan-level helpers: cutting lineage, ordering at scale, session defaults."""
