"""Timed-sequence and transcript analytics on Spark."""
