"""Document analytics on Spark: sources, functions, operators, plans and streams over block, segment and evaluation tables."""
