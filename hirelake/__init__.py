"""Spark-first analytics over job postings: ingestion rules, entity resolution, boards and metrics."""
