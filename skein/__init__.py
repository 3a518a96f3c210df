"""Staged structure analytics on Spark: points, graphs, mixtures, scores."""
