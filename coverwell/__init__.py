"""Coverage analytics as plain functions from Spark DataFrame to Spark DataFrame."""
