"""Signal-validity analytics on Spark."""
