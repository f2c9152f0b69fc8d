"""Customer-review analytics as plain Spark jobs: every job maps a DataFrame to a DataFrame."""
