"""Structured Streaming jobs that keep usage tables up to date."""
