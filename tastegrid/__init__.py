"""Spark-first analytics for messy, scraped product-review data."""
