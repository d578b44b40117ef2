"""vecspark: a versioned vector-analytics engine expressed on Spark DataFrames."""
