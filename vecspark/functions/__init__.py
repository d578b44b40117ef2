"""Column functions: distances, scores, parameter rules."""
