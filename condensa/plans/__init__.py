"""Ready-made plans over the given tables, with the same questions in SQL."""
