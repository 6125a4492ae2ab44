"""Continuous intake of yearly deliveries."""
