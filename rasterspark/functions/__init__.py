"""Column functions. Every one is built from JVM-side Spark functions, so it stays in generated code."""
