"""Catalog and measure operators built from DataFrame joins, aggregates and windows."""
