"""Column expressions of the language: typed, JVM-side, without UDFs."""
