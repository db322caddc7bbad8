"""Column functions; all but the pluggable ones stay in the JVM."""
