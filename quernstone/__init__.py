"""Spark-native analytics over scraped, dirty campaign records."""

__version__ = "0.1.0"
