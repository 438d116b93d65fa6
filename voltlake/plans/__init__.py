"""Whole queries: back-tests and jobs."""
