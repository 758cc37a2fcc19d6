"""DataFrame operators: retrieval, statistics, selection."""
