"""DataFrame operators: column resolution, joins, keys, merges, checks, specs."""
