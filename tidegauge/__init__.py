"""tidegauge: web-measurement analytics as DataFrame functions on Spark."""
