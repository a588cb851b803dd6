"""Column functions: expressions first, Arrow UDFs only where Spark has no built-in."""
