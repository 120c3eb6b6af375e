"""Point-in-time analytics on Spark: operators, sources, functions, query plans and streams."""
