"""Support-ticket analytics as ordinary Spark jobs."""
