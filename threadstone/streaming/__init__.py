"""Threadstone streaming."""
