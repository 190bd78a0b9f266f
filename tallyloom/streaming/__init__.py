"""Streams: review decisions as they come."""
