"""Readers and writers, settings, and the weather service."""
