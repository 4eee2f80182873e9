"""Streams of status events."""
