"""Operators put together for whole jobs."""
