"""Listings of public events, collected and checked on Spark."""
