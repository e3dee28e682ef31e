"""Listing extraction, enrichment, crawling and ranked search on Spark."""
