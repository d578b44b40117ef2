"""Operators over vector tables: search, filters, mutations, metrics, graph checks."""
