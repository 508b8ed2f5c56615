"""Registered queries, their input tables and their SQL."""
