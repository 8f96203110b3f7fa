"""Whole plans: a sample from its inputs to its summary and selected records, and derived test views."""
