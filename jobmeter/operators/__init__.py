"""DataFrame operators: joins, aggregations, windows, sampling."""
