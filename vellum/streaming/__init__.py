"""Streams of new containers."""
