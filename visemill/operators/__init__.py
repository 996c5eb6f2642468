"""DataFrame operators: joins, windows, aggregates and vector jobs."""
