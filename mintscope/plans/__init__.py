"""Feature families, scores, cost model and research tables."""
