"""Column expressions: each takes columns and returns a column, evaluated inside the JVM."""
