"""Market-event analytics on Spark: event logs in, books, checks, limits and summaries out."""

__version__ = "0.1.0"
