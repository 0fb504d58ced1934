"""Column functions; each takes and returns Columns and stays in the JVM unless said otherwise."""
