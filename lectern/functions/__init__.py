"""Column functions: JVM-side expressions, and Arrow UDFs where Spark has no expression."""
