"""Descriptive tables and survival statistics as distributed aggregates."""
