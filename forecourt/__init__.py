"""Used-car margin analytics as Spark DataFrame operators and Spark ML jobs."""
