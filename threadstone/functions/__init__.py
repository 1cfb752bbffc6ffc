"""Threadstone functions."""
