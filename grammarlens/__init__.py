"""Measures how data uses a formal grammar, as Spark jobs."""
