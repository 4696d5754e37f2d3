"""Training-data operators: neighbours, distinctiveness, top-N, percentiles, counts, co-occurrence, clusters,
packing, evaluation leaks and residue. Nothing else in the library imports this subpackage."""
