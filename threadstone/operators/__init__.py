"""Threadstone operators."""
