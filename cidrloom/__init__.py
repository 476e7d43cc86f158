"""A PySpark engine for data keyed by IP network."""
