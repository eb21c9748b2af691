"""Document sorting on Spark: learn folder labels, read dates and subjects, name and route files."""
