"""The pipeline: cleaning, staging, star schema, reports and quality."""
