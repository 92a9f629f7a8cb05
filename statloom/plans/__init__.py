"""Shared plans: moments, ordered running sums, ranks; the registry of queries."""
