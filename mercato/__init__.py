"""Marketplace analytics on Spark: cleaning, loading, star schema, quality and reports."""
