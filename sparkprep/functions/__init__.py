"""Building blocks shared by the operators: batched aggregates, quantiles, bins, global order, lookups."""
