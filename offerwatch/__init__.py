"""Listing-market monitoring expressed as Spark DataFrame jobs."""
