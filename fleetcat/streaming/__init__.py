"""Structured Streaming ingest of definition files into the catalog."""
