"""Whole query plans: staging, marts, reports, training and explanation."""
