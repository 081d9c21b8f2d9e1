"""Market-intelligence analytics as Spark DataFrame jobs."""
