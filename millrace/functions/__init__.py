"""Column helpers that stay inside Spark's generated code."""
