"""Column-to-column building blocks. All stay in the JVM; there is no Python UDF."""
