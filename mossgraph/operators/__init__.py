"""Operators over corpus tables: listings, search, graph, writes, changes, replicas and metrics."""
