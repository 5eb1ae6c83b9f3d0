"""spreadlab: two-settlement market spread analytics as Spark DataFrame jobs."""
