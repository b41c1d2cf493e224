"""Finds, reviews and safely transforms sensitive data in text, on Spark."""
