"""Threadstone sources."""
