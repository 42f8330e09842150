"""loomwatch: threat-intelligence analytics as plain Spark DataFrame jobs."""
