"""Readers and writers, and canonical views over the driver's tables."""
