"""Batch-job accounting, energy and emissions analytics as Spark DataFrame jobs."""
