"""Spark jobs that ask how far the classification of short time-series events can be trusted."""
