"""Whole analyses: coverage, validation, reports, jobs."""
