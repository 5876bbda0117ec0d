"""Workflows put together from operators."""
