"""Approximate search strategies."""
