"""Catalog extraction and product-record analytics on Spark."""
