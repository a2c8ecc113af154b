"""Column-level building blocks; everything here stays inside JVM expressions."""
