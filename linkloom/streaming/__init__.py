"""Micro-batch pipelines over the event log."""
