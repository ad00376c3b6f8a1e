"""Readers and parameter tables."""
