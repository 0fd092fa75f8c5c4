"""Weather-report analytics as Spark DataFrame operators."""
