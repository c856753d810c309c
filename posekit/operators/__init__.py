"""DataFrame operators: filters, joins, aggregates, windows, statistics."""
