"""Streams into tables of the engine."""
