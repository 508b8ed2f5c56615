"""Readers and writers of timed-text formats."""
