"""Performance-data analytics as lazy Spark DataFrame operators."""
