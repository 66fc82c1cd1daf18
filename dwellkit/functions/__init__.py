"""Column-level functions: every one is an expression that stays in the JVM."""
