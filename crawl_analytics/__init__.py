"""Web-crawl telemetry analytics as Spark DataFrame jobs."""
