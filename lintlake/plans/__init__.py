"""End-to-end plans and the registered query catalogue."""
