"""Fixtures: an encoder for note containers."""
