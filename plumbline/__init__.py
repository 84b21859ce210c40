"""A point-in-time analytics library of DataFrame operators."""
