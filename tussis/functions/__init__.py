"""Column to Column functions; all run inside the JVM unless stated."""
