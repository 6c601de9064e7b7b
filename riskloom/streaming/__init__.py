"""Structured streams of the daily features and of the last-kept rules."""
